"""thicket: analytics over branching conversation memory, expressed as Spark plans."""

__version__ = "0.1.0"
