"""Column builders: units, compatibility rules, names, evidence and portable casts."""
