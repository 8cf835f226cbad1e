"""The function library; importing the package registers every function."""

from lakemill.functions import bitmaps, control, numeric, sketches, strings, temporal
from lakemill.functions.registry import FUNCTIONS, build, call, literal

__all__ = ["FUNCTIONS", "bitmaps", "build", "call", "control", "literal", "numeric", "sketches", "strings", "temporal"]
