"""URL filters: glob rules as one bit-parallel wildcard automaton.

All rules' characters lie side by side in the bits of a few 64-bit words
(Shift-And). A step shifts every rule's states at once, keeps those whose next
character matches, and lets states at a wildcard stay. A batch of URLs takes
each step together; the few that are much longer than the rest go on one by one.

A URL is matched as host, SEP, path. In a rule ``*`` stands for any characters
within host or path, ``**`` for any characters at all. Rules given as host and
path see both as they stand in the URL; globs see its canonical form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEP = "\n"  # in rules; in URLs the boundary is no character, so none can imitate it
_BOUNDARY = 0x110000
#: URLs that a step is taken for together; fewer go on one by one.
TOGETHER = 16
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def canonical(host: str, path: str, query: str) -> tuple[str, str]:
    """Host and path in the form that globs are matched against.

    The host loses a user part, a port and dots at its end. In the path, escapes of plain characters are decoded and
    others put in capitals, ``.`` and ``..`` are resolved, runs of slashes become one; an empty path is ``/``. A query
    follows it after a question mark, its escapes treated alike.
    """
    host = host.rpartition("@")[2]
    host = re.sub(r":[0-9]*\Z", "", host).rstrip(".")
    decode = lambda m: c if (c := chr(int(m[1], 16))) in _PLAIN else m[0].upper()
    if "%" in path:
        path = _ESCAPE.sub(decode, path)
    if "//" in path or "/." in path:
        out: list[str] = []
        parts_ = path.split("/")
        for part in parts_:
            if part == "..":
                if out:
                    out.pop()
            elif part not in ("", "."):
                out.append(part)
        path = "/" + "/".join(out) + ("/" if out and parts_[-1] in ("", ".", "..") else "")
    return host, (path or "/") + ("?" + _ESCAPE.sub(decode, query) if query else "")


def read_globs(file: str | Path) -> list[str]:
    """The globs of a file such as ``url_globs.txt``."""
    out, section = [], "[globs]"
    for line in Path(file).read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if line.startswith("["):
            section = line
        elif not line or line.startswith("#"):
            continue
        elif section == "[words]":
            out += [f"{before}{w}{after}*{SEP}**" for w in line.split() for before in ("", "*.", "*-") for after in (".", "-")]
        elif section == "[folders]":
            out += [f"*{SEP}/{before}{w}/**" for w in line.split() for before in ("", "**/")]
        else:
            out.append(line.replace("/", SEP + "/", 1))
    return out


class Wildcards:
    """An automaton of glob rules; ``match`` tells for each URL which rules fit all of it."""

    def __init__(self, rules: list[str]):
        classes: dict[int, int] = {}
        bits: list[tuple[int | None, bool, bool]] = []  # (class to enter, loops on characters, loops on the boundary)
        self.final = []
        for rule in rules:
            bits.append((None, False, False))
            i = 0
            while i < len(rule):
                if rule[i] == "*":
                    wide = rule[i : i + 2] == "**"
                    enter, loop, cross = bits[-1]
                    bits[-1] = (enter, True, cross or wide)
                    i += 1 + wide
                    continue
                c = _BOUNDARY if rule[i] == SEP else ord(rule[i])
                bits.append((classes.setdefault(c, len(classes)), False, False))
                i += 1
            self.final.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.classes = classes
        self.enter = np.zeros((len(classes) + 1, self.words), dtype=np.uint64)  # the last row: characters in no rule
        self.stay = np.zeros((2, self.words), dtype=np.uint64)
        self.begin = np.zeros(self.words, dtype=np.uint64)
        for b, (enter, loop, cross) in enumerate(bits):
            one = np.uint64(1) << np.uint64(b % 64)
            if enter is None:
                self.begin[b // 64] |= one
            else:
                self.enter[enter, b // 64] |= one
            if loop:
                self.stay[0, b // 64] |= one
            if cross:
                self.stay[1, b // 64] |= one

    def match(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        out = np.zeros((len(hosts), len(self.final)), dtype=bool)
        sizes = np.array([len(h) + len(p) + 1 for h, p in zip(hosts, paths, strict=True)], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.fromiter((c for i in order for c in (*map(ord, hosts[i]), _BOUNDARY, *map(ord, paths[i]))), dtype=np.int64, count=int(sizes.sum()))
        known = np.array(sorted(self.classes), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        number = np.array([self.classes[c] for c in known.tolist()], dtype=np.int64)
        cls = np.where(known[at] == flat, number[at], len(self.classes)) if len(known) else np.zeros(len(flat), dtype=np.int64)
        edge = (flat == _BOUNDARY).astype(np.int64)
        sizes = sizes[order]
        base = np.cumsum(sizes) - sizes
        state = np.repeat(self.begin[None, :], len(order), axis=0)
        live, one, top = len(order), np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= step:
                live -= 1
            if live < TOGETHER:
                for i in range(live):
                    state[i] = self._alone(state[i], cls[base[i] + step : base[i] + sizes[i]], edge[base[i] + step : base[i] + sizes[i]])
                break
            d, here = state[:live], base[:live] + step
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.enter[cls[here]]) | (d & self.stay[edge[here]])
        for r, b in enumerate(self.final):
            out[order, r] = (state[:, b // 64] >> np.uint64(b % 64)) & one != 0
        return out


    def _alone(self, state: np.ndarray, cls: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The same steps for one URL, all masks as whole numbers."""
        whole = lambda words: int.from_bytes(np.ascontiguousarray(words, dtype="<u8").tobytes(), "little")
        enter, stay, d = [whole(x) for x in self.enter], [whole(x) for x in self.stay], whole(state)
        for c, e in zip(cls.tolist(), edge.tolist(), strict=True):
            d = (d << 1) & enter[c] | d & stay[e]
        return np.frombuffer(d.to_bytes(8 * self.words, "little"), dtype="<u8")


def globs(host: str, path: str) -> list[str]:
    """A rule on a host and all its subdomains and on a path's start."""
    return [f"{host}{SEP}{path}**", f"*.{host}{SEP}{path}**"]


def _judge(rules: list[tuple[str, str, str]], blocked: list[str]):
    patterns = [g for _, host, path in rules for g in globs(host, path)] + blocked
    length = np.array([len(h) + len(p) for _, h, p in rules])
    n = len(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Wildcards(patterns)
        for batch in batches:
            rule, verdict = [], []
            for lo in range(0, batch.num_rows, 4096):
                hosts, paths, queries = (batch.column(k).slice(lo, 4096).to_pylist() for k in (1, 2, 3))
                clean = [canonical(h, p, q) for h, p, q in zip(hosts, paths, queries, strict=True)]
                fits = automaton.match([h for h, _ in clean], [p for _, p in clean])
                bad = fits[:, 2 * n :].any(axis=1)
                # rules are about host and path as given
                other = [i for i, (h, p) in enumerate(clean) if h != hosts[i] or p != paths[i]]
                if other:
                    fits[other] = automaton.match([hosts[i] for i in other], [paths[i] for i in other])
                ruled = fits[:, : 2 * n].reshape(len(fits), n, 2).any(axis=2)
                best = np.where(ruled, length[None, :], -1).argmax(axis=1) if n else np.zeros(len(fits), dtype=int)
                has = ruled.any(axis=1)
                for i in range(len(fits)):
                    rule.append(rules[best[i]][1] + rules[best[i]][2] if has[i] else None)
                    verdict.append(rules[best[i]][0] if has[i] else "block" if hosts[i] and bad[i] else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: list[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row.

    ``rules`` are (allow or block, host, path): a rule fits its host, all subdomains and every path that
    starts with its own; the longest that fits decides, of equals the first. Other URLs are blocked
    if one of the globs ``blocked`` fits their canonical form and allowed otherwise. A null URL or one without ``://``
    has an empty host and path, and no glob fits it. Rows repeat as in the input.
    """
    host, path = parts(F.col("url").cast("string"))
    kind = pages.schema["page_id"].dataType.simpleString()
    query = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query")).mapInArrow(_judge(list(rules), list(blocked)), f"page_id {kind}, host string, path string, rule string, verdict string")
