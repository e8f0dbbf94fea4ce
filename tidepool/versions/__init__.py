"""Versioned image datasets: repositories, branches, checkpoints, commits, tags and vector fields."""

from .manager import Dataset, Manager, Repository, View
from .models import ModelDefinition, ModelRegistry
from .vectors import VectorField

__all__ = ["Dataset", "Manager", "ModelDefinition", "ModelRegistry", "Repository", "VectorField", "View"]
