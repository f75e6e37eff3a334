"""Driver-table facts, the registered queries and their SQL oracle."""
