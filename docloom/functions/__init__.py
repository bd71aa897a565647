"""Column functions: text clean-up, masking and the fixed values they need."""
