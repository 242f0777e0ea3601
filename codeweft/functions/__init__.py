"""Column functions and the vocabularies of roles, effects and guards."""
