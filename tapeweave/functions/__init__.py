"""Column-level functions: time frames, arithmetic, sizing, costs, text."""
