"""Tables of each target model, with its rules for repeated loads."""
