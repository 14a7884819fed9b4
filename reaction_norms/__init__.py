"""Reaction-norm (phenotypic plasticity) analytics as PySpark DataFrame jobs."""

from reaction_norms.operators.plasticity import DOY, LDMC, SLA, TRAITS, Trait

__all__ = ["DOY", "LDMC", "SLA", "TRAITS", "Trait"]
