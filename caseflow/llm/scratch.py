"""Tables in the shared folder that a later step has used up."""

from caseflow.scale import discard

__all__ = ["discard"]
