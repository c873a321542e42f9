"""Whether a run of capitalised words is a person's name, told by its shape and the words around it.

A logistic regression over the two words before and the one after, the shape of the run and
the endings of its words, fitted on the driver to the small table in ``name_labels`` with
made-up names (``ROUNDS`` of them for each sentence; ``MAX_LABELLED`` bounds the rows). No
list of names is used, so it holds for names of any origin.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import regex

from acequia.llm.name_labels import NAMES, SENTENCES

MAX_LABELLED = 6_000
ROUNDS = 5
DECAY, STEPS = 1e-3, 300
#: A run counts as a name from this probability on.
SURE = 0.55

_CAP = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}[\p{Ll}]+)?"
_LINK = r"(?:\s+(?:de|del|de la|da|dos|van|von|bin|al))?"
#: Two to four capitalised words, the later ones perhaps linked.
RUN = regex.compile(r"(?<![\w@.&/-])" + _CAP + r"(?:" + _LINK + r"[ ]" + _CAP + r"){1,3}(?![\w@&])")
_BEFORE = re.compile(r"(\S+)?\s+(\S+)\s*$|(\S+)\s*$")
_AFTER = re.compile(r"\s*(\S+)")


def _word(w: str | None) -> str:
    low = re.sub("[0-9]+", "#", (w or "").lower())
    return low if len(low) <= 14 else "~"


def features_of(text: str, a: int, b: int) -> dict[str, float]:
    """What a run text[a:b] is judged by."""
    left, right = text[max(0, a - 40) : a], text[b : b + 20]
    line = left.rsplit("\n", 1)[-1]
    m = _BEFORE.search(line)
    w1 = _word((m.group(2) or m.group(3)) if m else None)
    w2 = _word(m.group(1) if m else None)
    r = _AFTER.match(right.split("\n", 1)[0])
    words = re.findall(r"[\w'’-]+", text[a:b])
    out = {"": 1.0, f"l1 {w1}": 1.5, f"l2 {w2} {w1}": 1.0, f"r {_word(r.group(1) if r else None)}": 1.0, f"n {len(words)}": 0.5}
    if not w1:
        out["begins"] = 1.0
    if w1 and w1[-1] in ".!?" and w1 not in ("sr.", "sra.", "dr.", "dra.", "mr.", "ms.", "mrs.", "lic.", "ing."):
        out["begins"] = 1.0
    if any(w in ("de", "del", "la", "da", "dos", "y", "and", "of", "to", "the") for w in words):
        out["linked"] = 0.5
    for k, w in enumerate((words[0], words[-1])):
        low = w.lower()
        out[f"w{k} {low}"] = 1.0
        out[f"e{k} {low[-3:]}"] = 0.4
    return out


def _made_up(rnd: random.Random) -> str:
    def part(kind: str) -> str:
        a, m, e = NAMES[kind]
        return rnd.choice(a) + rnd.choice(m) * rnd.randint(0, 1) + rnd.choice(e)

    family = [part("family") for _ in range(rnd.choice([1, 1, 2]))]
    return " ".join([part("given"), *family])


@lru_cache(maxsize=1)
def fit() -> dict[str, float]:
    """feature -> weight."""
    rnd, rows, ys = random.Random(17), [], []
    for sentence in SENTENCES.strip().split("\n"):
        for _ in range(ROUNDS if "[N]" in sentence else 2):
            text, spans = rnd.choice(["", "Un texto antes. ", "Some text before.\n"]), set()
            for i, piece in enumerate(sentence.split("[N]")):
                if i:
                    name = _made_up(rnd)
                    spans.add((len(text), len(text) + len(name)))
                    text += name
                text += piece
            text += rnd.choice(["", " Y algo más."])
            for m in RUN.finditer(text):
                for span in spans_of(text, *m.span()):
                    rows.append(features_of(text, *span))
                    ys.append(float(span in spans))
    if len(rows) > MAX_LABELLED:
        raise ValueError("the labelled table is meant to be small")
    names = sorted({f for x in rows for f in x})
    at = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.array(ys)
    for i, row in enumerate(rows):
        for f, v in row.items():
            x[i, at[f]] = v
    w = np.zeros(len(names))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 2.0 * (x.T @ (p - y) / len(y) + DECAY * w)
    return dict(zip(names, w.tolist()))


def spans_of(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The run itself and what is left of it without its first word (which may open the sentence)."""
    out = [(a, b)]
    gap = regex.search(r"\s+(?=\p{Lu})", text, pos=a, endpos=b)
    if gap and RUN.fullmatch(text, gap.end(), b):
        out.append((gap.end(), b))
    return out


def score(text: str, a: int, b: int) -> float:
    """The probability that text[a:b] is a name."""
    w = fit()
    z = sum(v * w.get(f, 0.0) for f, v in features_of(text, a, b).items())
    return 1 / (1 + np.exp(-z))


def names_in(text: str) -> list[tuple[int, int]]:
    """The runs of a text that are names, the likelier of two that overlap."""
    out = []
    for m in RUN.finditer(text):
        p, at = max((score(text, a, b), (a, b)) for a, b in spans_of(text, *m.span()))
        if p >= SURE:
            out.append(at)
    return out
