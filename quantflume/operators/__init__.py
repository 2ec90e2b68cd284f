"""Part of quantflume; see the package README."""
