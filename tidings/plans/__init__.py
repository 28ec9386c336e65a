"""Plan shapes shared by many operators, and the multi-step plans built from them."""
