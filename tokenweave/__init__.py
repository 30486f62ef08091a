"""Markov models over token sequences as Spark DataFrames: train, prune, combine, sample, persist."""

from tokenweave.plans.model import MarkovModel

__all__ = ["MarkovModel"]
