"""Frame schemas, status names and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

SNIPPETS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
    ]
)
STORED_SNIPPETS = T.StructType(
    SNIPPETS.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
MANIFEST = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("content_hash", T.StringType()),
    ]
)
#: Where a file's snippets lie: runs of rows in data files of the snippet table.
PLACES = T.ArrayType(
    T.StructType(
        [
            T.StructField("data_file", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("rows", T.LongType()),
        ]
    )
)
FILE_LOG = T.StructType(
    MANIFEST.fields
    + [
        T.StructField("status", T.StringType()),
        T.StructField("known", T.BooleanType()),
        T.StructField("places", PLACES),
    ]
)
#: Bitmap over ``CHUNK`` rows of a data file; a set bit is a row that no longer counts.
DELETIONS = T.StructType(
    [
        T.StructField("data_file", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("words", T.ArrayType(T.LongType())),
    ]
)
CHUNK = 4096

NEW, CHANGED, TOUCHED = "NEW", "CHANGED", "TOUCHED"
UNCHANGED, REMOVED, SKIPPED = "UNCHANGED", "REMOVED", "SKIPPED"

# Suffix -> language, ignored directory names and size limits.
EXTENSIONS = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".dart": "dart",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
}
IGNORED_DIRS = frozenset(
    [
        ".git",
        ".hg",
        ".svn",
        "__pycache__",
        ".pytest_cache",
        ".ruff_cache",
        ".mypy_cache",
        ".tox",
        ".nox",
        ".venv",
        "venv",
        "env",
        ".env",
        "node_modules",
        "bower_components",
        "dist",
        "build",
        ".next",
        ".nuxt",
        ".output",
        "target",
        ".idea",
        ".vscode",
        ".dart_tool",
        "coverage",
        "htmlcov",
        ".eggs",
    ]
)
MAX_FILE_BYTES = 1_000_000
MAX_BLOCK_LINES = 60
MIN_BLOCK_LINES = 3
ID_LENGTH = 12
TOP_K = 5
EMBED_BATCH = 32
DEFAULT_MODEL = "all-MiniLM-L6-v2"
