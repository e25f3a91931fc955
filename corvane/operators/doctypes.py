"""Document types by rules on the file name, path, headings and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..registry import CLASSIFIERS

# The patterns of each type in order of priority, and the weights of a hit.
RULES: dict[str, dict[str, list[str]]] = {
    "resume": {"filename": ["resume", "(?<![a-z])cv(?![a-z])", "curriculum"], "headings": ["(work )?experience", "education", "skills", "projects", "summary"], "keywords": ["references available", "professional experience"]},
    "cover_letter": {"filename": ["cover[ _-]?letter"], "keywords": ["dear (hiring|sir|madam|mr|ms)", "sincerely", "i am writing to (apply|express)"]},
    "jd": {
        "filename": ["(?<![a-z])jd(?![a-z])", "job[ _-]?(description|posting)"],
        "headings": ["responsibilities", "requirements", "qualifications", "about the (role|job)", "what you('| wi)ll do", "nice to have", "benefits"],
        "keywords": ["we are (hiring|looking for)", "years of experience", "apply now", "equal opportunity"],
    },
    "invoice": {"filename": ["invoice", "receipt"], "headings": ["bill to", "amount due", "subtotal"], "keywords": ["invoice (no|number|#)", "amount due", r"\btotal\b", "due date"]},
    "paper": {"headings": ["abstract", "introduction", "references", "related work", "conclusion"], "keywords": [r"\bdoi\b", "arxiv", r"et al\."]},
    "plan": {"path": ["/plans/", r"/\.claude/", r"plan\.md$"], "filename": ["plan"], "headings": ["context", "verification", "steps", "build order", "plan"]},
    "notes": {"path": ["/memory/", "/notes?/"], "filename": ["notes?", "todo", "journal"]},
}
FILENAME, PATH, HEADING, HEADING_CAP, KEYWORD, KEYWORD_CAP, THRESHOLD, HEAD_LINES = 0.5, 0.4, 0.15, 0.5, 0.1, 0.3, 0.4, 400
CODE = ".c .h .cpp .hpp .cc .cxx .rs .go .dart .java .cs .kt .kts .scala .swift .py .ts .tsx .js .jsx .mjs .cjs .php .rb .lua .r .sh .bash .ps1".split()


def _any(value: Column, patterns: list[str]) -> Column:
    return value.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: x.rlike(f"(?i)^(?:{pattern})$"))


def scores(path: Column, text: Column) -> dict[str, Column]:
    """One rule score of 0 to 1 for each type; a registered classifier, a function of path and text, adds a type or takes a rule's place."""
    head = F.slice(F.split(text, "\n"), 1, HEAD_LINES)
    lines = F.transform(head, lambda x: F.trim(F.regexp_replace(F.trim(x), "^[#*:]+|[#*:]+$", "")))
    joined = F.array_join(head, "\n")
    stem = T.stem_of(T.base_name(path))
    out = {name: F.round(F.least(F.lit(1.0), CLASSIFIERS[name](path, text)), 6) for name in CLASSIFIERS}
    for name, rule in RULES.items():
        if name in out:
            continue
        # a heading counts once for each pattern that a whole line matches
        headings = sum((_line(lines, p).cast("int") for p in rule.get("headings", [])), F.lit(0))
        keywords = sum((joined.rlike(f"(?i){p}").cast("int") for p in rule.get("keywords", [])), F.lit(0))
        total = F.when(_any(stem, rule.get("filename", [])), FILENAME).otherwise(0.0) + F.when(_any(path, rule.get("path", [])), PATH).otherwise(0.0)
        total = total + F.least(F.lit(HEADING_CAP), headings * HEADING) + F.least(F.lit(KEYWORD_CAP), keywords * KEYWORD)
        out[name] = F.round(F.least(F.lit(1.0), total), 6)
    return out


def classify(docs: DataFrame, bonus: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, doc_type, confidence): the best type, of equals the first by priority; below the threshold ``other``.

    ``bonus`` adds to a type's score, such as that of a prototype vector.
    """
    found = scores(F.col("path"), F.col("text"))
    ranked = [F.struct(F.least(F.lit(1.0), s + (bonus or {}).get(n, F.lit(0.0))).alias("score"), F.lit(-i).alias("priority"), F.lit(n).alias("name")) for i, (n, s) in enumerate(found.items())]
    best = docs.select("doc_id", T.extension(T.file_name(F.col("path"))).alias("ext"), F.array_max(F.array(*ranked)).alias("best"))
    code = F.concat(F.lit("."), "ext").isin(CODE)
    good = F.col("best.score") >= THRESHOLD
    return best.select("doc_id", F.when(code, "code").when(good, F.col("best.name")).otherwise("other").alias("doc_type"), F.round(F.when(code, 1.0).when(good, F.col("best.score")).otherwise(1 - F.col("best.score")), 6).alias("confidence"))


def prototype_bonus(cosine: Column, weight: float = 0.4) -> Column:
    """Weighted evidence of a cosine between 0.35 and 0.8."""
    return weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - 0.35) / 0.45))
