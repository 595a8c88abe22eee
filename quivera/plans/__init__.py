"""The graph model, its schema, and the planners of traversals and native queries."""
