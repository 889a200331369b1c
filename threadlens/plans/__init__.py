"""End-to-end plans: files to messages, statistics and exports."""
