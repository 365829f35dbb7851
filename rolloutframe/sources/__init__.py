"""Readers, writers and the views that give the test tables the shape of rollouts."""
