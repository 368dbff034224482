"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs: list[tuple[int, str | None]], span: int = 20) -> dict[int, tuple[int, int, str]]:
    split = sorted((i, WORD.findall(t or "")) for i, t in docs)
    first: dict[tuple, tuple] = {}
    for i, w in split:
        for s in range(len(w) - span + 1):
            first.setdefault(tuple(w[s : s + span]), (i, s))
    out = {}
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] != (i, s):
                gone[s : s + span] = [True] * span
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = 10) -> dict[int, tuple]:
    windows = defaultdict(set)
    for i, t in items:
        w = TERM.findall(lower(t or ""))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[s : s + size])].add(i)
    out = {}
    for i, t in docs:
        w = TERM.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit[s : s + n] = [True] * n
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit))
    return out


def quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    counts = Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4))
    again = [False] * len(w)
    for s in range(len(w) - 4):
        if counts[tuple(w[s : s + 5])] > 1:
            again[s : s + 5] = [True] * 5
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", t)),
        len(lines) - len(set(lines)),
        sum(again),
        len(w) < 10 or 100 * sum(again) > 20 * len(w),
    )


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return sorted(
        [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        + [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    )


def url_parts(url: str | None) -> tuple[str, str, str | None]:
    """Host, path and the longest stated rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    best = None
    for rule in ("com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"):
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best
