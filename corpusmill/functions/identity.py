"""Identity, state, file-class and page-count functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col

# File classes by extension.
PLAINTEXT_EXT = [
    ".md", ".markdown", ".txt", ".text", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".css",
    ".scss", ".less", ".sass", ".py", ".pyw", ".pyi", ".pyx", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".kt",
    ".kts", ".scala", ".groovy", ".c", ".h", ".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".cs", ".fs", ".fsx", ".go", ".rs", ".rb",
    ".php", ".pl", ".pm", ".lua", ".swift", ".m", ".mm", ".r", ".jl", ".sh", ".bash", ".zsh", ".fish", ".bat", ".cmd", ".ps1",
    ".sql", ".graphql", ".gql", ".env", ".gitignore", ".dockerignore", ".editorconfig", ".makefile", ".cmake", ".log", ".rst",
    ".tex", ".bib", ".org", ".adoc", ".asciidoc", ".vue", ".svelte", ".astro", ".tf", ".hcl", ".proto",
]
AUDIO_EXT = [
    ".mp3", ".mp4", ".mpeg", ".mpga", ".m4a", ".wav", ".webm",
]
DIRECT_EXT = [
    ".csv", ".tsv", ".html", ".htm", ".xhtml",
]
IMAGE_EXT = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".svg", ".heic", ".heif",
]
BASIC_PARSER_EXT = [
    ".pdf", ".docx", ".xlsx", ".pptx", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp",
]
DOCUMENT_EXT = [
    ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".docm", ".dot", ".dotm", ".pptm", ".pot", ".potx", ".xlsm",
    ".xlsb", ".xlw", ".rtf", ".epub", ".odt", ".ods", ".odp", ".hwp",
]

# Bytes per page by extension.
PAGE_BYTES = {
    100 * 1024: (
        ".pdf .xls .xlsx .xlsm .xlsb .xlw .xlr .ods .ots .fods .numbers .123 .wk1 .wk2 .wk3 .wk4 .wks .wb1 .wb2 .wb3 .wq1 "
        ".wq2 .csv .tsv .slk .sylk .dif .dbf .prn .qpw .602 .et .eth"
    ).split(),
    50 * 1024: (
        ".doc .docx .docm .dot .dotm .odt .ott .sxw .stw .uot .rtf .pages .wpd .wps .abw .zabw .cwk .hwp .lwp .mcw .mw "
        ".sdw .vor .epub"
    ).split(),
    200 * 1024: ".ppt .pptx .pptm .pot .potx .odp .otp .sxi .sti .uop .key .sda .sdd .sdp".split(),
    3000: ".txt .log .md .markdown .htm .html .xml".split(),
    1024 * 1024: ".mp3 .m4a .wav .mpga".split(),
    5 * 1024 * 1024: ".mp4 .mpeg .webm".split(),
}
ONE_PAGE_EXT = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".svg", ".cgm", ".odg", ".pbd",
]
OTHER_PAGE_BYTES = 80 * 1024


def identifier_hash(doc_type: Column | str, uid: Column | str, space: Column | str) -> Column:
    """Stable identity of a source item."""
    return F.sha2(F.concat_ws(":", col(doc_type), col(uid).cast("string"), col(space).cast("string")), 256)


def content_hash(space: Column | str, text: Column | str) -> Column:
    """Content identity, scoped to a space."""
    return F.sha2(F.concat_ws(":", col(space).cast("string"), col(text)), 256)


def doc_state(status: Column | str) -> Column:
    """State of a JSON status; no status means ready."""
    return F.coalesce(F.get_json_object(col(status), "$.state"), F.lit("ready"))


def failure_reason(status: Column | str) -> Column:
    return F.left(F.get_json_object(col(status), "$.reason"), F.lit(500))


def status_json(state: str, reason: Column | None = None) -> Column:
    fields = [F.lit(state).alias("state")]
    if reason is not None:
        fields.append(F.left(reason, F.lit(500)).alias("reason"))
    return F.to_json(F.struct(*fields))


def suffix(name: Column | str) -> Column:
    """Lower-case extension with its dot; empty for none or a leading-dot name."""
    return F.lower(F.regexp_extract(col(name), r"[^/](\.[^./]+)$", 1))


def classify_file(name: Column | str) -> Column:
    ext = suffix(name)
    return (
        F.when(ext.isin(PLAINTEXT_EXT), "plaintext")
        .when(ext.isin(AUDIO_EXT), "audio")
        .when(ext.isin(DIRECT_EXT), "direct_convert")
        .when(ext.isin(IMAGE_EXT), "image")
        .when(ext.isin(DOCUMENT_EXT), "document")
        .otherwise("unsupported")
    )


def skip_file(name: Column | str, parser_ext: list[str]) -> Column:
    """True where the file is unsupported, or needs a parser that does not read its extension."""
    kind = classify_file(name)
    return (kind == "unsupported") | (kind.isin("document", "image") & ~suffix(name).isin(parser_ext))


def estimate_pages(name: Column | str, size: Column | str, n_chars: Column | str | None = None) -> Column:
    """Pages from extension and byte size; with a text length, the larger of that and 2000 characters a page."""
    ext, size = suffix(name), F.coalesce(col(size), F.lit(0)).cast("bigint")
    per = None
    for unit, exts in PAGE_BYTES.items():
        per = F.when(ext.isin(exts), F.lit(unit)) if per is None else per.when(ext.isin(exts), F.lit(unit))
    per = per.otherwise(F.lit(OTHER_PAGE_BYTES))
    pages = F.when((size <= 0) | ext.isin(ONE_PAGE_EXT), F.lit(1).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.floor(size / per))
    )
    if n_chars is None:
        return pages
    return F.greatest(pages, F.floor(col(n_chars) / 2000))
