"""Column expressions. All of them compile to Catalyst expressions (higher-order array
functions, math functions), so they run in the JVM inside whole-stage code generation
and never ship rows to Python."""

from pairlab.functions.vectors import *  # noqa: F401,F403
from pairlab.functions.scores import *  # noqa: F401,F403
