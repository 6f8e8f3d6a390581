"""Market and document analytics as composable DataFrame operators."""
