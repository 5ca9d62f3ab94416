"""All query modules; importing this fills the registry."""

from threadloom.plans import code, contexts, documents, exports, extraction, projects, sessions, streams  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES  # noqa: F401
