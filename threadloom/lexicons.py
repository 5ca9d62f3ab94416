"""Default word lists. Every operator takes them as a parameter; these are only the defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# ---- Fixed values: the phrases, words, names and order below decide the results. ----------------

GOAL_INTENTS = (
    "i want to build", "build a", "create a", "we need to", "let's build", "i'm building",
)

GOAL_PREFIXES = (
    "i want to build ", "i want to create ", "i want to make ", "i need to build ",
    "i need to create ", "i'd like to build ", "i'd like to create ",
    "can you help me build ", "can you help me create ", "help me build ", "help me create ",
    "build me ", "create ", "i want ", "i need ",
)

DECISION_PHRASES = (
    "let's use", "we'll go with", "decided to", "we should use", "i think we should",
    "going with", "we're using", "recommendation:", "recommend ", "i recommend", "i suggest",
    "suggested:", "for a local", "the best approach", "a good choice", "works well for",
    "start with", "use the browser", "for the frontend", "for the backend", "for styling",
    "for auth", "for the database",
)

CONSTRAINT_PHRASES = (
    "must", "cannot", "should not", "requirement:", "constraint:", "needs to", "has to",
    "required to", "to start", "initially", "for now", "keep it simple", "run locally",
    "local only", "easy to swap", "can be swapped",
)

NON_GOAL_PHRASES = (
    "not in scope", "out of scope", "won't", "we don't need", "skip", "not needed",
    "not for v1", "not for phase 1",
)

TASK_HEADERS = ("next steps:", "todo:", "tasks:", "action items:", "to do:")

TECH_KEYWORDS = {
    "language": {
        "python": "Python", "typescript": "TypeScript", "javascript": "JavaScript", "go": "Go",
        "rust": "Rust", "java": "Java", "ruby": "Ruby", "kotlin": "Kotlin",
    },
    "framework": {
        "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "express": "Express",
        "nextjs": "Next.js", "react": "React", "vue": "Vue", "angular": "Angular",
        "rails": "Rails",
    },
    "database": {
        "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mysql": "MySQL",
        "sqlite": "SQLite", "mongodb": "MongoDB", "redis": "Redis", "dynamodb": "DynamoDB",
        "supabase": "Supabase",
    },
    "testing": {
        "pytest": "pytest", "jest": "Jest", "unittest": "unittest", "vitest": "Vitest",
        "mocha": "Mocha", "cypress": "Cypress",
    },
    "infra": {
        "docker": "Docker", "kubernetes": "Kubernetes", "aws": "AWS", "gcp": "GCP",
        "azure": "Azure", "vercel": "Vercel", "railway": "Railway", "fly.io": "Fly.io",
    },
    "ai": {
        "claude": "Claude", "chatgpt": "ChatGPT", "gemini": "Gemini",
        "perplexity": "Perplexity", "google takeout": "Google Takeout",
    },
}

MUST_SUBJECT = r"(?iU)\b(it|the\s+\w+|we|you|this|system|api|service|app)\s+must\b"

LIST_ITEM = r"(?Udm)^\s*(?:\d+[.)]\s+|[-*]\s+|Phase\s+\d+\s*[—\-–]\s*)(.+)$"

# a question starts where a sentence does; saying so keeps the search linear
QUESTION = r"(?Udm)(?<![^.!?])[^.!?]*+\?"

OPEN_POINT = r"(?Udm)^(?:TBD|tbd|open question:|unclear:)\s*(.+)$"

SESSION_DECISION = (
    r"(?iUd)(?:I (?:chose|decided|opted|selected|went with|picked)\b.{20,150})"
    r"|(?:(?:chose to|we (?:chose|decided|opted|went with))\b.{20,120})"
    r"|(?:instead of\b.{20,100})"
    r"|(?:rather than\b.{20,100})"
    r"|(?:(?:approach|strategy|pattern|design)[:—]\s*.{20,150})"
)

TITLE_STOP_WORDS = (
    "a", "an", "the", "for", "with", "and", "or", "to", "in", "on", "of", "is", "it", "by",
    "at", "from", "as", "about", "how", "what", "my", "this", "that", "i", "me",
)

TASK_STOP_WORDS = (
    "a", "an", "and", "the", "to", "of", "for", "in", "on", "with", "build", "add", "create",
    "update", "implement", "use", "run", "set", "setup", "configure", "from", "into", "by",
    "as", "at", "via", "is", "are", "be", "new", "all", "any", "this", "that",
)

TITLE_SEPARATOR = r"(?U)\s*[-—:|/]\s*"

DOMAIN_KEYWORDS = {
    "backend-agent": (
        "fastapi", "django", "flask", "express", "rest", "endpoint", "api", "uvicorn",
        "graphql", "node.js", "spring",
    ),
    "frontend-agent": (
        "react", "vue", "svelte", "angular", "frontend", "ui", "css", "tailwind", "component",
        "tsx", "jsx",
    ),
    "database-agent": (
        "postgres", "postgresql", "mysql", "mongodb", "sqlite", "migration", "schema", "sql",
        "orm", "prisma", "alembic",
    ),
    "test-agent": (
        "pytest", "jest", "vitest", "mocha", "junit", "unit test", "test coverage", "tdd",
        "fixture", "mock",
    ),
    "devops-agent": (
        "docker", "kubernetes", "k8s", "ci/cd", "github actions", "terraform", "ansible",
        "deploy", "helm", "ecs", "lambda",
    ),
    "docs-agent": (
        "readme", "documentation", "api docs", "mkdocs", "sphinx", "swagger", "openapi",
        "docstring",
    ),
}

DOMAIN_SKILLS = {
    "backend-agent": ("rest-conventions",),
    "frontend-agent": ("accessibility-checklist",),
}

CREATE_TOOLS = ("Write", "NotebookEdit")
MODIFY_TOOLS = ("Edit", "MultiEdit")

EXCLUDED_DIRS = (
    "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".git", ".claude",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "egg-info",
)

# ---- End of fixed values. ------------------------------------------------------------------------


@dataclass(frozen=True)
class DomainRule:
    name: str
    keywords: tuple[str, ...]
    skills: tuple[str, ...] = ()


DOMAIN_RULES = tuple(
    DomainRule(name, keywords, DOMAIN_SKILLS.get(name, ()))
    for name, keywords in DOMAIN_KEYWORDS.items()
)


@dataclass(frozen=True)
class Lexicon:
    """Word lists that drive rule extraction; replace any of them to extract by other words."""

    intents: Sequence[str] = GOAL_INTENTS
    goal_prefixes: Sequence[str] = GOAL_PREFIXES
    decisions: Sequence[str] = DECISION_PHRASES
    constraints: Sequence[str] = CONSTRAINT_PHRASES
    non_goals: Sequence[str] = NON_GOAL_PHRASES
    task_headers: Sequence[str] = TASK_HEADERS
    tech: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: TECH_KEYWORDS)
    needs_subject: str | None = "must"


DEFAULT_LEXICON = Lexicon()


# ---- Fixed values: source-file extensions and patterns. ------------------------------------------

PYTHON_EXTENSIONS = (".py",)
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")

SCRIPT_EXPORT = (
    r"(?Udm)^export\s+(?:default\s+)?(?:async\s+)?"
    r"(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"
)

SCRIPT_IMPORT = r"""(?Udm)^import\s+(?:.+?\s+from\s+)?['"]([^'"]+)['"]"""

# ---- End of fixed values. ------------------------------------------------------------------------
