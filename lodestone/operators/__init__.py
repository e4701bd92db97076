"""Placement, catalogue state, listing, merging and the replayable state machines."""
