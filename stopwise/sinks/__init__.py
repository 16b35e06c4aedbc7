"""Tables, exports and state."""
