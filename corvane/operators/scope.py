"""Which files are indexed, as one ordered chain of native predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Name patterns of secrets, their exceptions, and of noise.
SECRET = ".env .env.* *.pem *.key *.pfx *.p12 id_rsa* id_ed25519* *credential* .npmrc .pypirc *.kdbx client_secret*.json *service-account*.json *serviceaccount*.json *adminsdk*.json token.json *.ppk id_dsa* id_ecdsa* .netrc _netrc *.jks *.keystore .htpasswd secrets.json secrets.yaml secrets.yml secrets.toml".split()
SECRET_EXCEPT = [".env.example", ".env.sample", ".env.template"]
NOISE = "*.min.js *.min.css *.map *.lock package-lock.json pnpm-lock.yaml yarn.lock npm-shrinkwrap.json go.sum composer.lock gemfile.lock poetry.lock uv.lock pipfile.lock .aider*history* .aider.tags.cache*".split()
TEXT_NAMES = "dockerfile makefile readme license licence copying .gitignore .gitattributes .dockerignore .editorconfig .env.example .env.sample .env.template .cursorrules .windsurfrules".split()
KIND_OF = {
    "code": ".c .h .cpp .hpp .cc .cxx .rs .go .dart .java .cs .kt .kts .scala .swift .gradle .py .ts .tsx .js .jsx .mjs .cjs .vue .svelte .php .rb .lua .r .sh .bash .ps1 .bat .cmd .html .htm .css .scss .sass .less .svg .sql .json .yaml .yml .toml .xml .ini .cfg .ipynb .csv .tsv".split(),
    "doc": ".md .mdc .markdown .txt .tex .pdf .docx .pptx .rtf".split(),
    "image": ".png .jpg .jpeg .webp .gif .bmp .tif .tiff".split(),
}
# Folders that are never entered, system folders first.
BLOCKED_DIRS = [
    "windows", "$recycle.bin", "system volume information", "recovery", "program files", "program files (x86)", "programdata", "appdata", "windows.old", "perflogs", "inetpub", "intel", "msocache", "onedrivetemp", "documents and settings", "drivers", "$windows.~bt", "$windows.~ws",
    "steamapps", "site-packages", "dist-packages",
    "node_modules", ".git", "target", "dist", "build", "out", "bin", "obj", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode", ".next", ".nuxt", ".cache", "vendor", "pkg",
]
# Whole paths of secrets; hidden folders of AI tools and what is read in each; their folders that are left out; files of agent rules.
SECRET_PATHS = ["**/.claude/settings*.json"]
AI_NOTES = {
    ".claude": ["**/*.md"], ".cursor": ["rules/**", "*.md", "*.mdc"], ".github": ["copilot-instructions.md", "instructions/**/*.md", "prompts/**"], ".gemini": ["**/*.md"], ".codex": ["**/*.md"],
    ".continue": ["**/*.md", "rules/**"], ".windsurf": ["**/*.md", "rules/**"], ".kiro": ["**/*.md"], ".aider*": ["**/*.md"],
}
AI_LEFT_OUT = ["plugins", "shell-snapshots", "todos", "statsig", "ide", "cache"]
AGENT_RULES = ["claude.md", "agents.md", "gemini.md", ".cursorrules", ".windsurfrules"]
# Folder names that are protected on any drive.
PROTECTED = ["$recycle.bin", "system volume information", "windows.old"]
MOST_MB = {"code": 15, "doc": 200, "image": 100}


def glob_to_regex(glob: str) -> str:
    """``**/`` any directories, ``**`` anything, ``*`` and ``?`` within one part; the whole path must match."""
    out, i = "", 0
    while i < len(glob):
        for token, pattern in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(token, i):
                out, i = out + pattern, i + len(token)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def _names(patterns: list[str]) -> str:
    return "|".join(glob_to_regex(p) for p in patterns)


def posix(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def parts_of(path: Column) -> Column:
    """Lower-cased parts of a path."""
    return F.filter(F.split(posix(path), "/"), lambda x: x != "")


def folders_of(path: Column) -> Column:
    parts = parts_of(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def is_secret(path: Column) -> Column:
    name = T.file_name(path)
    return ~name.isin(SECRET_EXCEPT) & (name.rlike(_names(SECRET)) | posix(path).rlike(_names(SECRET_PATHS)))


def file_kind(path: Column) -> Column:
    name = T.file_name(path)
    ext = F.concat(F.lit("."), T.extension(name))
    return F.coalesce(F.when(name.isin(TEXT_NAMES), "code"), *(F.when(ext.isin(exts), kind) for kind, exts in KIND_OF.items()))



def in_blocked_dir(path: Column, root: Column | None = None) -> Column:
    """A folder of the path is blocked; of a path below ``root`` only folders below it count."""
    folders = folders_of(path)
    if root is not None:
        above = parts_of(root)
        under = (F.size(above) > 0) & (F.slice(folders, 1, F.size(above)) == above)
        folders = F.when(under, F.slice(folders, F.size(above) + 1, F.size(folders) + 1)).otherwise(folders)
    return F.exists(folders, lambda x: x.isin(BLOCKED_DIRS))


def _ai_tool(part: Column) -> Column:
    """The AI tool that a folder belongs to, null for others."""
    return F.coalesce(*(F.when(part.rlike(glob_to_regex(k)), k) for k in AI_NOTES))


def _hidden(part: Column) -> Column:
    return part.startswith(".") & ~part.isin(".", "..")


def ai_note_source(path: Column) -> Column:
    """claude-plan, claude-memory or agent-rules for notes of AI tools, else null."""
    parts, folders = parts_of(path), folders_of(path)
    at = F.array_position(F.transform(folders, lambda x: _ai_tool(x).isNotNull()), True).cast("int")
    below = F.slice(folders, at + 1, F.size(folders) + 1)
    mine = F.when(F.get(parts, at - 1) == ".claude", F.when(F.array_contains(below, "plans"), "claude-plan").when(F.array_contains(below, "memory"), "claude-memory"))
    return F.when(at > 0, F.coalesce(mine, F.lit("agent-rules"))).when(F.element_at(parts, -1).isin(AGENT_RULES), "agent-rules")


def protected(path: Column, *, system: list[str] = (), profiles: str = "c:/users", home: str = "") -> Column:
    """Part of the operating system or of someone else's profile: ``system`` folders, ``profiles`` but ``home``, recycle bins anywhere."""
    low = F.regexp_replace(posix(path), "/+$", "")
    below = lambda d: (low == d) | low.startswith(d + "/")
    tidy = lambda d: d.lower().replace("\\", "/").rstrip("/")
    out = F.exists(parts_of(path), lambda x: x.isin(PROTECTED))
    for d in map(tidy, system):
        out = out | below(d)
    other = low.startswith(tidy(profiles) + "/")
    return out | (other & ~below(tidy(home)) if home else other)


def path_allowed(path: Column, root: Column | None = None) -> Column:
    """No blocked folder below the root; hidden folders only those of AI tools, and of the first such one only its notes."""
    parts, folders = parts_of(path), folders_of(path)
    hidden = F.transform(folders, _hidden)
    stray = F.exists(folders, lambda x: _hidden(x) & _ai_tool(x).isNull())
    at = F.array_position(hidden, True).cast("int")
    tool = _ai_tool(F.get(folders, at - 1))
    below = F.slice(parts, at + 1, F.size(parts) + 1)
    left_out = F.exists(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), lambda x: x.isin(AI_LEFT_OUT))
    rest = F.array_join(below, "/")
    noted = F.coalesce(*(F.when(tool == k, rest.rlike(_names(globs))) for k, globs in AI_NOTES.items()), F.lit(False))
    return ~in_blocked_dir(path, root) & ~stray & ((F.coalesce(at, F.lit(0)) == 0) | (~left_out & noted))


def descend(folder: Column) -> Column:
    """Whether a walk enters a folder: not blocked, hidden only for AI tools, none of the folders that these leave out."""
    parts = parts_of(folder)
    name = F.element_at(parts, -1)
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    inside = F.exists(above, lambda x: _ai_tool(x).isNotNull())
    barred = name.isin(BLOCKED_DIRS) | (_hidden(name) & _ai_tool(name).isNull()) | (name.isin(AI_LEFT_OUT) & inside)
    return F.when(F.size(parts) == 0, True).otherwise(~barred)


def ignore_rules(files: DataFrame, root: str = "") -> DataFrame:
    """(dir, n, pattern, negated) of ignore files (path, text), one row for each rule: a regular expression for the path below the file's folder."""

    lines = files.select(F.regexp_replace(posix(F.col("path")), "/?[^/]*$", "").alias("dir"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    rule = F.rtrim("line")
    kept = lines.select("dir", "n", rule.alias("rule")).where("rule <> '' AND NOT startswith(rule, '#')")
    negated = F.col("rule").startswith("!")
    glob = F.when(negated, F.substring("rule", 2, 1 << 20)).otherwise(F.col("rule"))
    bare = F.regexp_replace(F.lower(glob), r"^/|/+$", "")
    anchored = F.regexp_replace(glob, "/+$", "").contains("/")
    # ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within one part; what else has a meaning in an expression is quoted
    quoted = F.regexp_replace(bare, r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*\*/", "\u0001"), r"\*\*", "\u0002"), r"\*", "[^/]*"), r"\?", "[^/]")
    body = F.regexp_replace(F.regexp_replace(body, "\u0001", "(?:.*/)?"), "\u0002", ".*")
    folder = glob.endswith("/")
    pattern = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), body, F.when(folder, "/.*$").otherwise("(?:/.*)?$"))
    return kept.select("dir", "n", pattern.alias("pattern"), negated.alias("negated"))


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (path) with ``ignored``: in any folder above, the last of its rules that fits says so. Files meet rules by folder in an equi-join."""
    low = posix(F.col("path"))
    parts = F.split(low, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = files.select("path", low.alias("low"), F.explode(F.array_distinct(F.array_union(above, F.array(F.lit(""))))).alias("dir")).join(rules, "dir")
    rest = F.when(F.col("dir") == "", F.col("low")).otherwise(F.substring("low", F.length("dir") + 2, F.length("low")))
    fits = met.where(F.rlike(rest, F.col("pattern")))
    said = fits.groupBy("path", "dir").agg(F.max_by(~F.col("negated"), "n").alias("out")).groupBy("path").agg(F.bool_or("out").alias("ignored"))
    return files.join(said, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def reject_reason(path: Column, size: Column, root: Column | None = None) -> Column:
    """The first rule against a file, null if none: secret, noise, kind, path, empty, size."""
    kind = file_kind(path)
    most = reduce(lambda e, k: F.when(kind == k, MOST_MB[k]).otherwise(e), MOST_MB, F.lit(0))
    return (
        F.when(is_secret(path), "secret").when(T.file_name(path).rlike(_names(NOISE)), "noise").when(kind.isNull(), "kind")
        .when(~path_allowed(path, root), "path").when(size == 0, "empty").when(size > most * 1048576, "size")
    )


def expand_drive(roots: list[str], system: str, folders: list[str]) -> list[str]:
    """``roots`` with the system drive's own root replaced by its unprotected ``folders``."""
    tidy = lambda p: p.lower().replace("\\", "/").rstrip("/")
    out: list[str] = []
    for r in roots:
        out += [f for f in folders if tidy(f).split("/")[-1] not in BLOCKED_DIRS] if tidy(r) == tidy(system) else [r]
    return out


def never_send(files: DataFrame, types: DataFrame, blocked_types: list[str], globs: list[str]) -> DataFrame:
    """``files`` (path) with ``blocked``: a secret, a blocked document type (``types``: path, doc_type) or a glob's match."""
    low = F.lower(F.regexp_replace("path", r"\\", "/"))
    by_glob = low.rlike("|".join(map(glob_to_regex, globs))) if globs else F.lit(False)
    typed = files.join(types, "path", "left")
    return typed.withColumn("blocked", is_secret(F.col("path")) | by_glob | F.coalesce(F.col("doc_type").isin(blocked_types), F.lit(False)))


def project_of(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``files`` (path) with ``project``: the nearest ancestor folder with a repository, else the nearest with another marker.

    ``markers`` has (dir, repository) of folders; a repository's files all belong to it, however deep their own markers
    lie. Ancestors meet markers in an equi-join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("path", F.explode(above).alias("dir"))
    found = each.join(markers, "dir").groupBy("path").agg(F.max_by("dir", F.struct("repository", F.length("dir"))).alias("project"))
    return files.join(found, "path", "left")


def drop_nested(roots: DataFrame) -> DataFrame:
    """``roots`` (path) without those below another one."""
    low = lambda c: F.lower(F.regexp_replace(c, "[/\\\\]+$", ""))
    distinct = roots.withColumn("key", low("path")).dropDuplicates(["key"])
    parts = F.split("key", r"[/\\]")
    above = distinct.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).where("up <> key")
    nested = above.join(distinct.select(F.col("key").alias("up")), "up", "left_semi").select("key").distinct()
    return distinct.join(nested, "key", "left_anti").select("path")
