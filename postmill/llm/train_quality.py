"""Learning of the structural profiles: python -m postmill.llm.train_quality DOCUMENTS.parquet [DOCS].

Lines of a bounded sample (DOCS, 6000 by default) that plain signs mark beyond doubt give the mean
distribution of each profile; the profiles then decide about all lines.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np

from postmill.llm.quality import _ENUM, _TOKEN, LANGS, PROFILES, S, line_signs, repeated, sign


def mark(line: str, before: str, after: str) -> str | None:
    """The profile that a line is beyond doubt an example of."""
    s = line.strip()
    body = _ENUM.sub("", s)
    tokens = _TOKEN.findall(body)
    signs = [sign(t) for t in tokens]
    words = sum(x in (S["verbal"], S["nominal"], S["word"], S["name"]) for x in signs)
    verbal = signs.count(S["verbal"])
    n = max(1, len(tokens))
    if not re.search(r"\w", s):
        return "table rules" if re.search(r"[|+]", s) else "junk signs"
    if s.count("|") >= 2 or re.search(r"(?:^| )! .* ! ", s):
        return "table bars"
    if "\t" in s:
        return "table tabs"
    if len(re.findall(r"\S {3,}", s)) >= 1:
        return "table columns"
    if '":' in s:
        return "junk data"
    if " at 0x" in s:
        return "junk log"
    if "()=>" in s or "&&" in s:
        return "junk code"
    if " " not in s and len(s) > 40:
        return "junk encoded"
    if signs.count(S["broken"]) > 0.3 * n:
        return "junk broken"
    if signs.count(S["odd"]) > 0.4 * n and n > 3:
        return "junk letters"
    if signs.count(S["figure"]) > 0.9 * n and n > 4:
        return "junk figures"
    if re.search(r"\S;\S.*;\S", s) and not re.search(r"; ", s):
        return "table fields"
    if len(tokens) >= 24 and len(set(zip(*(tokens[i:] for i in range(9))))) < 0.3 * len(tokens):
        return "junk same"
    parts = re.split(r"[;,] ", body)
    if len(parts) >= 6 and verbal < 0.06 * n and s[-1] not in ".!?":
        return "list inline"
    if s[-1] in ".!?" and words >= 4 and verbal >= 1:
        return "prose"
    if words >= 9 and verbal >= 2:
        return "prose open"
    short = lambda x: bool(x.strip()) and len(x.split()) <= 12 and x.strip()[-1] not in ".!?:"
    if short(line) and short(before) and short(after) and verbal == 0:
        return "list bullets" if _ENUM.match(s) else "list items"
    return None


def main(path: str, most: int = 6000) -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["text", "lang"]).to_pydict()
    sums: dict[str, list] = {}
    for text, lang in list(zip(t["text"], t["lang"]))[:most]:
        if not text or not text.strip():
            continue
        lines = [x for x in text.split("\n") if x.strip()]
        same = repeated(text)
        for i, x in enumerate(lines):
            name = "junk same" if same else mark(x, lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else "")
            if name is None or name.startswith("prose") and lang not in LANGS:
                continue
            c, f = line_signs(x)
            if name.startswith("prose"):
                # The declared language is wrong at times: the line's function words must agree with it.
                if f.sum() == 0 or f.argmax() != LANGS.index(lang):
                    continue
                name = f"{name} {lang}"
            s = sums.setdefault(name, [np.zeros(len(c)), np.zeros(len(f)), 0])
            s[0] += c / c.sum()
            s[1] += f / max(1, f.sum())
            s[2] += 1
    out = {}
    for name, (c, f, n) in sorted(sums.items()):
        print(name, n)
        if n >= 5:
            c = c / n + 1e-4
            f = f / n + 1e-4
            out[name] = {"signs": [round(float(x), 5) for x in c / c.sum()], "langs": [round(float(x), 5) for x in f / f.sum()]}
    with open(PROFILES, "w") as fh:
        json.dump(out, fh, indent=0)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
