"""Column functions: no UDFs, everything stays in generated code or higher-order functions."""
from .geo import *  # noqa: F401,F403
from .hashing import *  # noqa: F401,F403
from .quality import *  # noqa: F401,F403
from .similarity import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .vectors import *  # noqa: F401,F403
