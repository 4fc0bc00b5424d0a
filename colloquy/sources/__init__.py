"""Files, their texts, and configuration."""
