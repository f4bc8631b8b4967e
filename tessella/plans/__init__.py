"""Relation plans, and statements that are pinned before they run."""
