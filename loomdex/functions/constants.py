"""They must equal the ones users of the original service know."""

# Default ignore rules, applied after the user's own.
DEFAULT_IGNORE_RULES = (
    "venv/",
    "__pycache__/",
    "migrations/",
    ".git/",
    ".pytest_cache/",
    "*.pyc",
    "*.pyo",
    "*.pyd",
    ".env",
    "dist/",
    "build/",
)

# File suffixes treated as source code when routing to a model.
CODE_SUFFIXES = (
    ".py",
    ".js",
    ".ts",
    ".java",
    ".c",
    ".cpp",
    ".cs",
    ".rb",
    ".go",
    ".php",
    ".rs",
    ".swift",
    ".kt",
    ".kts",
    ".sh",
    ".pl",
    ".r",
    ".lua",
    ".sql",
    ".scala",
    ".html",
    ".css",
    ".json",
    ".xml",
    ".yml",
    ".yaml",
)

# Suffix to language, for files split into declarations.
LANGUAGE_OF_SUFFIX = {
    ".js": "javascript",
    ".ts": "typescript",
    ".go": "go",
    ".java": "java",
}

# Model names stored with each chunk, and their vector space.
CODE_MODEL = "codebert-base"
TEXT_MODEL = "all-MiniLM-L6-v2"

# Defaults and limits of the query interface.
SNIFF_BYTES = 2048
DEFAULT_K = 5
DEFAULT_MAX_TOKENS = 8000
EMBED_BATCH = 32
REQUESTS_PER_MINUTE = 60
