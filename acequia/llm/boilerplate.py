"""Main body of web pages, by flat text blocks and a decision tree.

Each line of a page is a block. A block has its word count, its link density, cues of
cookie notices, prompts and footers, and the same for the blocks before and after it; a
block also knows how many entry-like blocks lie between it and the heading of a sidebar. A
decision tree, grown on the small table in ``boilerplate_labels``, classifies the blocks.

Plain text has no anchors. So link density is told twice: as the share of a line's words in
known texts of links, and, for sites whose links nobody listed, as the odds that words like
these stand in links, learned from the labelled table (a logistic regression; for the tree
the odds of a page's lines come from the other pages, so that it doesn't trust them more
than they deserve).

Both are fitted once on the driver (a few hundred rows; ``MAX_LABELLED`` bounds them) and
travel with the task; pages are classified where they lie, without a shuffle.

Defined results: null, empty and blank texts give no rows, nor does scanned text; blank
lines are never reported; a page may have no boilerplate or nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acequia.llm.boilerplate_labels import PAGES
from acequia.llm.textkind import is_scanned

MAX_LABELLED = 2_000
MAX_DEPTH = 12

# Texts of links and buttons, by place.
NAVIGATION = (
    "inicio|empleos|mensajes|mi red|buscar|empresas|notificaciones|personas|ayuda|iniciar sesión|saltar al contenido|unirse ahora|yo|cursos|premium|perfil|menú"
    "|home|jobs|messaging|my network|search|companies|notifications|people|help|sign in|skip to main content|join now|me|learning|profile|menu|log in|sign up"
    "|início|vagas|mensagens|minha rede|pessoas|entrar|cadastre-se|pular para o conteúdo|notificações|perfil|pesquisar"
).split("|")
BUTTONS = "aceptar|aceptar todo|rechazar|rechazar todo|configurar|gestionar|accept|accept all|reject|reject all|manage|settings|aceitar|aceitar tudo|recusar|gerenciar|ver más|show more|ver mais|see more|mostrar más".split("|")
FOOTER = (
    "acerca de|idioma|condiciones de uso|accesibilidad|pautas comunitarias|descargá la aplicación|política de privacidad|centro de ayuda|publicidad|prensa|política de copyright"
    "|política de cookies|español|english|português|about|language|user agreement|accessibility|community guidelines|get the app|privacy policy|help center|copyright policy|cookie policy"
    "|acessibilidade|sobre|termos de uso|política de privacidade|baixe o aplicativo|diretrizes da comunidade|imprensa|publicidade|ajuda|contacto|contact|mapa del sitio|site map"
).split("|")
SIDEBARS = (
    "páginas que podrían interesarte|personas que quizás conozcas|otras personas también vieron|empleos similares|búsquedas relacionadas|people you may know|pages you may like|related searches"
    "|similar jobs|people also viewed|vagas similares|páginas relacionadas|pessoas também viram|pessoas que talvez você conheça|empresas similares|jobs you may like|buscas relacionadas"
).split("|")
SECTIONS = (
    "acerca del empleo|sobre mí|trayectoria|responsabilidades|requisitos|quiénes somos|beneficios|about the role|responsibilities|about me|track record|requirements|benefits|who we are"
    "|sobre a vaga|benefícios|sobre mim|quem somos|experiência|experiencia|experience|educación|education|formação"
).split("|")
#: Whole-line wording of notices, prompts, reactions and rights.
NOTICE = re.compile(
    r"usa cookies|we use cookies|usamos cookies|usamos tecnologías similares|cookie policy|política de cookies|datos en tu dispositivo|information on your device|dados no seu dispositivo"
    r"|nuestros \d+ socios|our \d+ partners|\d+ parceiros|non-essential cookies|preferences at any time|cambiar tus preferencias|respetamos tu privacidad|consent or reject",
    re.I,
)
PROMPT = re.compile(
    r"^(?:inici[áa] sesión para|únete para|unite para|mirá quién|ya tengo cuenta|recibí alertas|denunciar (?:esta )?publica|recomendar\s+comentar|\d+ recomendaciones|\d+ rea[cç]|sign in to|join to"
    r"|already a member|get notified|see who|report this|like\s+comment|entre para|cadastre-se para|gostei\s+comentar|\d+ comentarios|\d+ comments|já tem conta|receba alertas)",
    re.I,
)
RIGHTS = re.compile(r"©|derechos reservados|rights reserved|direitos reservados", re.I)
_SEPARATOR = re.compile(r"\s*[|·›»>/•]\s*|\s{2,}")
_COUNTER = re.compile(r"\s*\(\d+\)$")
_BULLET = re.compile(r"^\s*[-*•–]\s+")
_ENTRY_COUNT = re.compile(r"\(\d+\)\s*$")
_CRUMB = re.compile(r"^\s*[^|·›»>/]{2,40}(?:\s+[›»>/]\s+[^|·›»>/]{2,40}){1,5}\s*$")
_LINKS = frozenset(NAVIGATION) | frozenset(BUTTONS) | frozenset(FOOTER)

FEATURES = [
    "words", "link_density", "notice", "prompt", "rights", "crumb", "bullet", "sentence", "section", "sidebar_head", "sidebar_run",
    "entry_count", "segments", "words_before", "link_before", "words_after", "link_after", "first", "odds", "odds_before", "odds_after", "odds_run", "known",
]
LINK, CUES = FEATURES.index("link_density"), [FEATURES.index(f) for f in ("notice", "prompt", "rights", "crumb", "sidebar_head")]
KNOWN = len(FEATURES) - 1
ODDS = [i for i, f in enumerate(FEATURES) if f.startswith("odds")]
#: What says little about sites nobody listed, and how deep their part of the tree may be.
SPECIAL = [FEATURES.index(f) for f in ("crumb", "entry_count", "known")]
GENERAL_DEPTH = 4
#: Of a page's lines so many are such cues where its site is known; only then the listed cues suffice.
KNOWN_SHARE = 0.15
#: Weight decay and steps of the odds' fit.
DECAY, STEPS = 3e-4, 400
#: Parts of the labelled pages; the odds of one part come from the others.
FOLDS = 5
_TOKEN = re.compile(r"[^\W\d_]+|[|·›»>/©]")


@lru_cache(maxsize=200_000)
def word_features(line: str) -> tuple[str, ...]:
    """The words of a line, its first and last pair, and how short it is."""
    words = _TOKEN.findall(line.lower())
    ends = "." if line.rstrip()[-1:] in ".!?" else "-"
    size = f"n{min(len(words), 8)}{ends}"
    return (*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), size)


def fit_odds(lines: list[str], y: np.ndarray) -> dict[str, float]:
    """feature -> weight of the odds that a line is boilerplate."""
    rows = [word_features(x) for x in lines]
    at = {f: i + 1 for i, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(at) + 1))
    x[:, 0] = 1.0
    for i, r in enumerate(rows):
        for f in r:
            x[i, at[f]] = len(r) ** -0.5
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        w -= 8.0 * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + DECAY * w)
    return {"": float(w[0])} | {f: float(w[i]) for f, i in at.items()}


#: Odds are told in grades: against, likely against, undecided, likely for, for.
GRADES = np.array([-1.5, -0.5, 0.5, 1.5])


def odds(weights: dict[str, float], line: str) -> float:
    """Log odds that a line is boilerplate, by its words alone."""
    r = word_features(line)
    return weights[""] + sum(weights.get(f, 0.0) for f in r) * len(r) ** -0.5 if r else 0.0


def link_density(line: str) -> float:
    """Share of a line's words that lie in known anchor texts."""
    parts = [_COUNTER.sub("", p).strip().lower() for p in _SEPARATOR.split(line.strip()) if p.strip()]
    total = sum(len(p.split()) for p in parts)
    linked = sum(len(p.split()) for p in parts if p in _LINKS or RIGHTS.search(p))
    if not linked and parts:  # "English Español Português" runs without separators
        words = parts[0].split()
        linked = len(words) if len(words) > 1 and all(w in _LINKS for w in words) else 0
    return linked / total if total else 0.0


@lru_cache(maxsize=300_000)
def _line(line: str) -> tuple:
    """What a line says by itself: words, link density, and its cues (see FEATURES)."""
    x = line.strip()
    low = _COUNTER.sub("", x).lower()
    words = len(line.split())
    crumb = bool(_CRUMB.match(x)) and _SEPARATOR.split(x)[0].strip().lower() in _LINKS
    sentence = bool(re.search(r"[.!?]$", x)) and words >= 5
    cues = (bool(NOTICE.search(x)), bool(PROMPT.match(x)), bool(RIGHTS.search(x)), crumb, bool(_BULLET.match(line)), sentence, low in SECTIONS, low in SIDEBARS)
    return words, link_density(line), cues, bool(_ENTRY_COUNT.search(x)), len(_SEPARATOR.split(x)), low


def block_features(text: str, weights: dict[str, float], score: Callable[[str], float] | None = None) -> tuple[list[int], np.ndarray]:
    """(line numbers of the non-blank lines, one row of FEATURES for each).

    ``score`` gives the odds of a line, if they are kept from line to line.
    """
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    own = [_line(lines[i]) for i in at]
    said = [score(lines[i].strip()) if score else odds(weights, lines[i].strip()) for i in at]
    rows, run, last = [], -1, len(at) - 1
    for k, i in enumerate(at):
        words, link, cues, counted, segments, low = own[k]
        notice, prompt, rights, crumb, bullet, sentence, section, head = cues
        if head:
            run = 0
        elif run >= 0:
            gap = k > 0 and i - at[k - 1] > 1
            closed = k > 0 and low != "" and lines[at[k - 1]].strip().lower() in ("ver más", "show more", "ver mais")
            linked = link > 0.5 or prompt or notice
            if gap or closed or section or bullet or (linked and low not in BUTTONS) or (sentence and words > 6) or words > 9:
                run = -1
            else:
                run += 1
        before, after = own[k - 1] if k else None, own[k + 1] if k < last else None
        rows.append([
            words, link, *cues, run, counted, segments, before[0] if before else 0, before[1] if before else 0,
            after[0] if after else 0, after[1] if after else 0, k == 0,
        ])
    # how much of the page is cues of sites whose links are listed
    x = np.zeros((len(rows), len(FEATURES)))
    if rows:
        x[:, : ODDS[0]] = rows
        by_words = np.zeros((len(rows), 4))
        by_words[:, 0], by_words[1:, 1], by_words[:-1, 2] = said, said[:-1], said[1:]
        # the mean odds of the lines beside a line, within three of it
        sums, k = np.concatenate([[0.0], np.cumsum(said)]), np.arange(len(rows))
        low, high = np.maximum(k - 3, 0), np.minimum(k + 4, len(rows))
        by_words[:, 3] = (sums[high] - sums[low]) / (high - low)
        x[:, ODDS] = np.searchsorted(GRADES, by_words)
        cue = (x[:, LINK] > 0.5) | x[:, CUES].any(axis=1)
        x[:, -1] = cue.mean()
    return at, x


def _labelled_pages() -> list[tuple[str, list[str], list[int]]]:
    """(text, non-blank lines, labels) of each labelled page; 1 is boilerplate."""
    out = []
    for page in PAGES:
        marked = page.strip("\n").split("\n")
        own = [m for m in marked if not m.startswith("=")]
        out.append(("\n".join("" if m.startswith("=") else m[2:] for m in marked), [m[2:] for m in own], [int(m[0] == "-") for m in own]))
    return out


@lru_cache(maxsize=1)
def labelled_table() -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Features, labels and the weights of the odds; a page's odds come from the other pages."""
    pages = _labelled_pages()
    if sum(len(y) for _, _, y in pages) > MAX_LABELLED:
        raise ValueError("the labelled table is meant to be small")
    xs: list = [None] * len(pages)
    for fold in range(FOLDS):
        rest = [p for j, p in enumerate(pages) if j % FOLDS != fold]
        weights = fit_odds([x for _, xs_, _ in rest for x in xs_], np.array([v for _, _, y in rest for v in y], dtype=float))
        for i in range(fold, len(pages), FOLDS):
            xs[i] = block_features(pages[i][0], weights)[1]
    lines, y = [x for _, xs_, _ in pages for x in xs_], np.array([v for _, _, ys in pages for v in ys])
    return np.vstack(xs), y, fit_odds(lines, y.astype(float))


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 0, least: int = 2) -> dict:
    """A binary decision tree by Gini impurity; ties go to the first feature and cut."""
    leaf = {"boilerplate": bool(y.mean() >= 0.5) if len(y) else False}
    if depth >= MAX_DEPTH or len(y) < 2 * least or _gini(y) == 0:
        return leaf
    best = (_gini(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            n = left.sum()
            if min(n, len(y) - n) < least:
                continue
            impurity = (n * _gini(y[left]) + (len(y) - n) * _gini(y[~left])) / len(y)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return {"feature": best[1], "cut": float(best[2]), "low": grow_tree(x[left], y[left], depth + 1, least), "high": grow_tree(x[~left], y[~left], depth + 1, least)}


def classify(tree: dict, x: np.ndarray) -> np.ndarray:
    """Boilerplate flags of feature rows."""
    out = np.zeros(len(x), dtype=bool)

    def go(node: dict, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if "feature" not in node:
            out[idx] = node["boilerplate"]
            return
        low = x[idx, node["feature"]] <= node["cut"]
        go(node["low"], idx[low])
        go(node["high"], idx[~low])

    go(tree, np.arange(len(x)))
    return out


def fit() -> dict:
    """The tree and the weights of the odds.

    The root of the tree asks whether the page's site is known; below it pages of known
    sites are told by the listed cues, all others by the learned odds too.
    """
    x, y, weights = labelled_table()
    cues = x.copy()
    cues[:, ODDS] = 0.0
    known = x[:, KNOWN] > KNOWN_SHARE
    general = x.copy()
    general[:, SPECIAL] = 0.0
    low = grow_tree(general, y, MAX_DEPTH - GENERAL_DEPTH, least=5)
    tree = {"feature": KNOWN, "cut": KNOWN_SHARE, "low": low, "high": grow_tree(cues[known], y[known], least=3)}
    return {"tree": tree, "odds": weights}


def line_scorer(model: dict) -> Callable[[str], float]:
    """The odds of a line, kept for the lines that come back."""
    return lru_cache(maxsize=300_000)(lambda line: odds(model["odds"], line))


def boilerplate_lines(model: dict, text: str | None, score: Callable[[str], float] | None = None) -> list[int]:
    """Numbers of the lines of a page that aren't main body."""
    if not text or not text.strip() or is_scanned(text):
        return []
    at, x = block_features(text, model["odds"], score)
    return [i for i, b in zip(at, classify(model["tree"], x)) if b]


def find_boilerplate(rows: DataFrame) -> DataFrame:
    """(table_name, ingest_seq, line_no) for rows (table_name, ingest_seq, text)."""
    tree = fit()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = line_scorer(tree)
        for pdf in batches:
            out = [(t, s, i) for t, s, x in zip(pdf.table_name, pdf.ingest_seq, pdf.text) for i in boilerplate_lines(tree, x, score)]
            yield pd.DataFrame(out, columns=["table_name", "ingest_seq", "line_no"])

    slim = rows.select("table_name", "ingest_seq", "text").where("text is not null")
    return slim.mapInPandas(run, "table_name string, ingest_seq bigint, line_no bigint")


def main_body(rows: DataFrame) -> DataFrame:
    """(table_name, ingest_seq, text): pages cut down to their main body."""
    tree = fit()

    @F.pandas_udf("string")
    def body(texts: pd.Series) -> pd.Series:
        def cut(x: str) -> str:
            drop = set(boilerplate_lines(tree, x))
            return "\n".join(line for i, line in enumerate(x.split("\n")) if i not in drop) if drop else x

        return texts.map(cut, na_action="ignore")

    return rows.select("table_name", "ingest_seq", body("text").alias("text"))
