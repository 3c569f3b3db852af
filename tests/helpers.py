"""Plain-Python statements of the sequential rules, written for the tests."""

import random
import re
from difflib import SequenceMatcher


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def random_texts(n, seed, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def markdown_chunks(text):
    marks = [m for m in re.finditer(r"^(#{1,2})\s+(.+)$", text, re.MULTILINE)]
    bounds = [0, *[m.start() for m in marks], len(text)]
    names = ["(preamble)", *[m.group(0) for m in marks]]
    parts = [(text[a:b].strip(), name) for a, b, name in zip(bounds, bounds[1:], names)]
    return [(i, t, s) for i, (t, s) in enumerate(p for p in parts if p[0])]


def caps(line):
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 2 and all(c.isupper() for c in letters)


def plaintext_chunks(text):
    lines, sections, body, name, i = text.splitlines(keepends=True), [], [], "(document)", 0
    while i < len(lines):
        line = lines[i].strip()
        rule = lines[i + 1].strip() if i + 1 < len(lines) else ""
        underlined = bool(line) and len(rule) >= 3 and set(rule) in ({"="}, {"-"})
        if underlined or caps(line):
            sections.append(("".join(body).strip(), name))
            body, name = [], line
        body.append(lines[i])
        i += 2 if underlined else 1
    sections.append(("".join(body).strip(), name))
    return [(i, t, s) for i, (t, s) in enumerate(p for p in sections if p[0])]


def packed(text, limit):
    done, open_ = [], ""
    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        joined = f"{open_}\n\n{p}" if open_ else p
        if open_ and len(joined) > limit:
            done.append(open_)
            joined = p
        open_ = joined
    return done + ([open_] if open_ else [])


def near(evidence, text, threshold=0.8):
    """Every window, no short cuts."""
    if not evidence or not text:
        return False
    n, m = len(evidence), len(text)
    if m <= n:
        return SequenceMatcher(None, evidence, text).ratio() >= threshold
    step = max(1, n // 4)
    windows = [text[i : i + n] for i in range(0, m - n + 1, step)]
    windows += [text[i : i + n + step] for i in range(0, max(1, m - n - step), step)]
    return any(SequenceMatcher(None, evidence, w).ratio() >= threshold for w in windows)


def matched(evidence, chunk_id, chunks):
    """`match` of one reference against {chunk_id: text}."""
    flat = {k: re.sub(r"\s+", " ", t).strip() for k, t in chunks.items()}
    e = re.sub(r"\s+", " ", evidence).strip()
    if not e:
        return "none"
    if e in flat.get(chunk_id, ""):
        return "referenced"
    if any(e in t for t in flat.values()):
        return "elsewhere"
    return "similar" if any(near(e, t) for t in flat.values()) else "none"
