"""Pure numpy mathematics used inside grouped tasks; nothing here imports Spark."""
