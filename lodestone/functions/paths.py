"""Path functions and path rules as column expressions; paths are POSIX and relative to a root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let, strip

# The names and suffixes that the rules are about.
IGNORED_DIRS = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules", "dist", "build", ".venv", "venv")
TEXT_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".md", ".txt", ".toml", ".yaml", ".yml", ".json", ".ini", ".cfg", ".css", ".html")
PROTECTED_NAMES = (
    ".env", ".env.local", ".env.production", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json",
    "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa",
)
PROTECTED_SUFFIXES = (".cer", ".crt", ".key", ".p12", ".pem", ".pfx")


def parts(path: Column) -> Column:
    """The components of a path; ordering by them differs from ordering by the path itself."""
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """From the last dot of the name on; none if the name begins or ends with that dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def is_text_file(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*TEXT_SUFFIXES)


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(x) for x in IGNORED_DIRS]))


def is_protected(path: Column) -> Column:
    return F.lower(name(path)).isin(*PROTECTED_NAMES) | F.lower(suffix(path)).isin(*PROTECTED_SUFFIXES)


def is_below(path: Column, base: str) -> Column:
    """Whether the path is the base or lies below it; ``.`` is the root."""
    base = base.strip("/")
    while base.startswith("./"):
        base = base[2:]
    return F.lit(True) if base in ("", ".") else (path == base) | path.startswith(f"{base}/")


def skipped(path: Column, is_symlink: Column | None = None) -> Column:
    """Whether tools leave a path out: links, generated and protected files."""
    rule = is_ignored(path) | is_protected(path)
    return rule if is_symlink is None else rule | is_symlink


def _normal(steps: Column) -> Column:
    """Components without ``.``, with ``..`` taken back."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    return F.aggregate(steps, F.array().cast("array<string>"), step)


def path_verdict(path: Column, root: str, links: Column | None = None) -> Column:
    """Why a path may not be used, or null; the first rule that it breaks counts.

    ``root`` is absolute; ``links`` are the symbolic links below it, as an array
    of relative paths.  Only the text of a path is judged.
    """
    base = [p for p in root.split("/") if p]
    root_parts = F.array(*[F.lit(p) for p in base]).cast("array<string>")
    raw = F.when(path.startswith("/"), parts(path)).otherwise(F.concat(root_parts, parts(path)))

    def judged(own: Column) -> Column:
        below = F.slice(own, len(base) + 1, F.greatest(F.size(own) - len(base), F.lit(0)))
        last = F.element_at(own, -1)
        suffix_of = F.regexp_extract(last, r"^.+(\.[^.]+)$", 1)
        return (
            F.when(F.slice(own, 1, len(base)) != root_parts, F.concat(F.lit("Path escapes repository root: "), path))
            .when(F.arrays_overlap(below, F.array(*[F.lit(x) for x in IGNORED_DIRS])), F.concat(F.lit("Refusing to access generated or internal path: /"), F.array_join(own, "/")))
            .when(F.lower(last).isin(*PROTECTED_NAMES) | F.lower(suffix_of).isin(*PROTECTED_SUFFIXES), F.concat(F.lit("Refusing to access protected file: "), last))
        )

    def through_link(steps: Column) -> Column:
        """Whether a walk along the raw components stands on a link, also one that ``..`` leaves again."""
        start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("met"))

        def step(walk: Column, part: Column) -> Column:
            moved = F.when(part.isin("", "."), walk["at"]).when(part == "..", F.slice(walk["at"], 1, F.greatest(F.size(walk["at"]) - 1, F.lit(0)))).otherwise(F.array_append(walk["at"], part))
            return let(moved, lambda at: F.struct(at.alias("at"), (walk.met | (~part.isin("", ".", "..") & F.array_contains(known, F.array_join(at, "/")))).alias("met")))

        return F.aggregate(steps, start, step, lambda walk: walk.met)

    verdict = let(_normal(raw), judged)
    if links is not None:
        known = F.transform(links, lambda link: F.concat(F.lit("/".join([*base, ""])), link))
        verdict = F.when(F.coalesce(through_link(raw), F.lit(False)), F.concat(F.lit("Refusing to follow symlink path: "), path)).otherwise(verdict)
    return F.when(path.isNull(), F.lit("Path must be a string.")).when(strip(path) == "", F.lit("Path must be non-empty.")).otherwise(verdict)
