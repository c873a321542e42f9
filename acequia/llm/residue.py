"""Template residue, filler, error pages and script notices in a corpus.

Texts are cut into messages (sentences and lines) with their digits masked. Distinct
messages are sorted into a prefix tree of fixed depth: first the number of tokens, then
the first ``DEPTH`` tokens. Within a leaf a token stays constant at a position if it makes
up ``KEEP_SHARE`` of the leaf's messages there, else it becomes a wildcard; messages equal
after that are one template. Each template is classified once, by its constant words, how
much of it is slots and how often its words come back; messages that lost a word to a
wildcard are judged once more by their own words. Verdicts go back to the messages of the
template and from there to the documents that hold one. Unfilled slots inside ordinary
records are found separately, in the raw messages.

The classifier is a multinomial logistic regression over words, pairs of words and these
figures, fitted on the driver to the small table in ``residue_labels`` (``MAX_LABELLED``
bounds it). A template is residue if a class other than "ordinary" is the likeliest.

The documents are read and cut twice, once to mine and once to tell who holds a condemned
message. All else are aggregations over distinct messages with map-side combine, so no leaf
is ever gathered in one task.

Defined results: null, empty and blank texts are never residue; texts that write about
templates or errors aren't either; a document counts once however many messages condemn it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.llm.residue_labels import LABELLED
from acequia.session import broadcast_if_small, settle

DEPTH = 3
KEEP_SHARE = 0.05
WILD = "<*>"

#: Where a text is cut into messages.
BREAK = r"(?<=[.!?:…])\s+|[\r\n ]+"

# Notations of an unfilled slot (Java patterns).
SLOTS = [
    r"\{\{[^{}]{1,60}\}\}", r"\$\{[^{}]{1,60}\}", r"#\{[^{}]{1,60}\}", r"\{%[^%]{1,60}%\}", r"<%[^%]{1,60}%>",
    r"\[\[[^\[\]]{1,60}\]\]", r"@@\w{2,40}@@", r"<<[^<>]{2,40}>>", r"<[a-záéíóúñ]+_[a-z_áéíóúñ]+>", r"(?<![\w%])%[A-Z_]{3,30}%",
    r"(?<![\w$])\$[A-Z_]{3,30}\$", r"(?<!\w)__[A-Z_]{2,30}__(?!\w)", r"(?<![\w){])\{(?:\d{1,2}|[a-z]\w*(?:\.\w+)+)\}",
    r"(?<![\w$])X{4,}(?!\w)", r"(?<![\w$.])(?:undefined|NaN)(?![\w$(.])",
    r"(?i)\[(?:completar|insert|inserte|inserir|your|tu |su |nombre|name|fecha|date|empresa|company|puesto|job|cargo|ciudad|city|preencher|nome)[^\[\]]{0,40}\]",
    r"(?i)\[[^\[\]]{0,30}(?:here|aquí|aqui|title|de la empresa|da empresa)\]",
]
#: What every slot notation holds some of; most messages fail this cheap test.
SLOT_HINT = r"[{\[<$%@_]|XXXX|undefined|NaN"
#: A sentence that explains slots rather than failing to fill them.
ABOUT_SLOTS = (
    r"(?iu)\b(?:mostramos|probamos|imprimimos|usamos|escribimos|renderizamos|our templates|templates? (?:print|render|show)s?"
    r"|plantillas? (?:de \w+ )?(?:saluda|imprime|muestra)n?|sintaxis|syntax|tests? cover|we (?:print|render|use|test|write))\b"
)

CLASSES = ["ordinary", "error", "filler", "script"]
MAX_LABELLED = 2_000
#: Ordinary messages are many times as frequent in a corpus as in the labelled table.
PRIOR = 0.8
#: Weight decay and steps of the fit; the steps suffice to settle it on so few rows.
DECAY, STEPS = 2e-4, 1_500
#: Words that a message has at least before their coming back tells anything.
LONG = 8
_WORD = re.compile(r"[^\W\d_]+|[{}<>$#%=]")
_ACCENTS = str.maketrans("áéíóúüñãõâêôàç", "aeiouunaoaeoac")


def features_of(template: str) -> dict[str, float]:
    """What a template is judged by: words, pairs of words, slots, repetition."""
    words = _WORD.findall(template.replace(WILD, " ").lower().translate(_ACCENTS))
    n = len(words)
    pairs = list(zip(["^", *words], [*words, "$"])) if n else []
    scale = max(1, n) ** -0.5
    out = {w: scale for w in words} | {f"{a} {b}": scale for a, b in pairs}
    slots = template.count(WILD)
    out["\x00slots"] = slots / max(1, slots + n)
    if n >= LONG:
        out["\x00again"] = 3 * max(0.0, 1 - len(set(words)) / n - 0.2)
    return out


def labelled_table() -> tuple[list[dict[str, float]], np.ndarray]:
    """Features and classes of the labelled messages."""
    xs, ys = [], []
    for k, name in enumerate(CLASSES):
        for line in LABELLED[name].strip().split("\n"):
            xs.append(features_of(re.sub("[0-9]+", WILD, line)))
            ys.append(k)
    if len(ys) > MAX_LABELLED:
        raise ValueError("the labelled table is meant to be small")
    return xs, np.array(ys)


@lru_cache(maxsize=1)
def fit() -> dict[str, np.ndarray]:
    """feature -> weight per class; "" holds the biases."""
    xs, ys = labelled_table()
    names = sorted({f for x in xs for f in x})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(xs), len(names) + 1))
    for i, row in enumerate(xs):
        for f, v in row.items():
            x[i, at[f]] = v
    x[:, -1] = 1.0
    want = np.eye(len(CLASSES))[ys]
    w, pace = np.zeros((x.shape[1], len(CLASSES))), 4.0
    for _ in range(STEPS):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= pace * (x.T @ (p - want) / len(xs) + DECAY * w)
    return {f: w[i] for f, i in at.items()} | {"": w[-1] + PRIOR * np.eye(len(CLASSES))[0]}


def judge(weights: dict[str, np.ndarray], template: str) -> str:
    """The likeliest class of a template; one without words says nothing."""
    if not _WORD.search(template.replace(WILD, "")):
        return CLASSES[0]
    score = weights[""].copy()
    for f, v in features_of(template).items():
        if f in weights:
            score += v * weights[f]
    return CLASSES[int(score.argmax())]


def messages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, raw, message): the messages of each text, raw and with digits masked."""
    parts = F.explode(F.split(F.col(text), BREAK))
    cut = docs.select(F.col(key).alias("doc"), parts.alias("raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    one_space = F.when(F.col("raw").rlike(r"\s\s|[^\S ]"), F.regexp_replace("raw", r"\s+", " ")).otherwise(F.col("raw"))
    cut = cut.select("doc", one_space.alias("raw"))
    masked = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", "[0-9]+", WILD)).otherwise(F.col("raw"))
    return cut.withColumn("message", masked)


def mine_templates(msgs: DataFrame) -> DataFrame:
    """(message, n, template, lost, hollow): every distinct message with its template.

    ``lost`` tells that a word of the message became a wildcard there, ``hollow`` that more
    than a third of its tokens did: such a template says too little to be judged.
    """
    counted = settle(msgs.groupBy("message").agg(F.count("*").alias("n")), "p10-messages")
    tokens = F.split("message", " ")
    wild = lambda t: F.when(~t.rlike(r"\p{L}"), F.lit(WILD)).otherwise(t)
    leaf = counted.withColumn("tokens", tokens).withColumn(
        "path", F.xxhash64(F.size("tokens"), *[wild(F.get("tokens", F.lit(i))) for i in range(DEPTH)])
    )
    at = leaf.select("message", "n", "path", F.posexplode("tokens").alias("pos", "token")).withColumn("token", wild(F.col("token")))
    share = at.groupBy("path", "pos", "token").agg(F.sum("n").alias("k"))
    whole = leaf.groupBy("path").agg(F.sum("n").alias("total"))
    kept = share.join(whole, "path").where((F.col("pos") < DEPTH) | (F.col("k") >= KEEP_SHARE * F.col("total"))).select("path", "pos", "token", F.lit(True).alias("keep"))
    built = (
        at.join(kept, ["path", "pos", "token"], "left")
        .withColumn("starred", F.col("keep").isNull() & (F.col("token") != WILD))
        .withColumn("token", F.when(F.col("keep"), F.col("token")).otherwise(WILD))
        .groupBy("message", "n")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("parts"), F.sum(F.col("starred").cast("int")).alias("stars"))
    )
    hollow = F.col("stars") * 3 > F.size("parts")
    return built.select("message", "n", F.array_join("parts.token", " ").alias("template"), (F.col("stars") > 0).alias("lost"), hollow.alias("hollow"))


def classify_templates(mined: DataFrame) -> DataFrame:
    """(template, verdict): each template judged once."""
    weights = fit()

    @F.pandas_udf("string")
    def verdict(template: pd.Series) -> pd.Series:
        return template.map(lambda t: judge(weights, t))

    return mined.select("template").distinct().withColumn("verdict", verdict("template"))


def unresolved_slot(raw: Column) -> Column:
    """True for a message that holds an unfilled slot and doesn't explain slots."""
    return raw.rlike(SLOT_HINT) & raw.rlike("|".join(f"(?:{s})" for s in SLOTS)) & ~raw.rlike(ABOUT_SLOTS)


def find_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reason): one row per document that is residue, wholly or in part."""
    msgs = messages(docs, key, text)
    mined = settle(mine_templates(msgs), "p10-templates")
    whole = mined.where("not hollow")
    bad = classify_templates(whole).where("verdict <> 'ordinary'")
    by_own = classify_templates(mined.where("lost").select(F.col("message").alias("template"))).where("verdict <> 'ordinary'")
    condemned = whole.join(bad, "template").select("message", "verdict").unionByName(by_own.withColumnRenamed("template", "message"))
    condemned = settle(condemned.groupBy("message").agg(F.min("verdict").alias("verdict")), "p10-condemned")
    told = msgs.join(broadcast_if_small(condemned), "message", "left")
    reason = F.coalesce("verdict", F.when(unresolved_slot(F.col("raw")), F.lit("slot")))
    held = told.select("doc", reason.alias("reason")).where("reason is not null")
    return held.groupBy("doc").agg(F.min("reason").alias("reason")).withColumnRenamed("doc", key)


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus without the documents that are residue."""
    return docs.join(find_residue(docs, key, text).select(key), key, "left_anti")
