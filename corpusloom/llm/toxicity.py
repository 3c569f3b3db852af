"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers are composed. The lexical one reads a word and writes a class: insult (from a weighted lexicon of whole
words and stems, longest match first), threat, target, negation, reported speech, or other. The scope one reads the classes
of a clause and writes, for each insult or threat, in which scope it stands: plain, at a target, negated, or reported. The
weight one turns kind, strength and scope into log odds. A document's log odds are those of the distinct matches in its
clauses, or of having none.

Only the weights are learned: the lexicon from label folds 1 to 3 of a bounded sample (`max_toxic`, `max_clean` rows), the
scope weights from fold 4, so that entries that looked toxic by chance get weights from rows that did not choose them. Fold
0 is held out. Word counts for the lexicon are Spark aggregates; the driver sees the entries that the bounded sample bears out. Scoring
is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, map_slices, stored

MAX_TOXIC = 20_000
MAX_CLEAN = 60_000
LEAST_ROWS = 3  # toxic rows an entry needs
LEAST_WEIGHT = 1.8
STRENGTHS = (1.8, 3.0, 4.5)  # bounds of the strength classes
STEMS = range(4, 9)

# Word classes of the grammar; English, French, German and Spanish.
THREAT = {"kill", "hurt", "destroy", "beat", "burn", "tuer", "frapper", "töten", "schlagen", "matar", "golpear"}
TARGET = {"you", "your", "u", "they", "them", "tu", "toi", "vous", "du", "dich", "ihr", "usted", "ustedes", "ti"}
NEGATION = {"not", "no", "never", "isn", "aren", "don", "ne", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca"}
REPORT = {"said", "says", "wrote", "claimed", "quoted", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió"}
CLASSES = {w: name for name, words in (("H", THREAT), ("T", TARGET), ("N", NEGATION), ("R", REPORT)) for w in words}

TOKEN = re.compile(r"\w+|[.!?;\n]")
ENDS = set(".!?;\n")
NONE = "none"


def scope_machine(reach: int = 3) -> dict[tuple[str, str], tuple[str, str]]:
    """(state, class) to (next state, output). Negation and target reach some words on, report to the clause's end."""
    steps = {}
    for reported in ("", "r"):
        for kind in ("", *[f"n{i}" for i in range(1, reach + 1)], *[f"t{i}" for i in range(1, reach + 1)]):
            fades = f"{kind[0]}{int(kind[1]) - 1}" if kind and kind[1] != "1" else ""
            scope = "reported" if reported else {"": "plain", "n": "negated", "t": "target"}[kind[:1]]
            here = reported + kind
            steps[here, "w"] = (reported + fades, "")
            steps[here, "R"] = ("r" + fades, "")
            steps[here, "N"] = (f"{reported}n{reach}", "")
            steps[here, "T"] = (here if kind[:1] == "n" else f"{reported}t{reach}", "")
            for match in "IH":
                steps[here, match] = (here, scope)
    return steps


SCOPE = scope_machine()


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # whole words end in "$", stems do not
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0

    def lexical(self, word: str) -> tuple[str, int]:
        """Class and strength of a word."""
        weight = self.lexicon.get(word + "$")
        for size in reversed(STEMS):
            if weight is not None:
                break
            if len(word) >= size:
                weight = self.lexicon.get(word[:size])
        if weight is not None:
            return "I", sum(weight >= s for s in STRENGTHS)
        return CLASSES.get(word, "w"), 0

    def score(self, matches: set[str]) -> float:
        odds = self.prior + sum(self.weights.get(m, 0.0) for m in matches or {NONE})
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def clause_matches(tokens: list[str], lexical: dict[str, tuple[str, int]]) -> set[str]:
    """Distinct matches of a text: kind, strength and scope."""
    found, state = set(), ""
    for token in tokens:
        if token in ENDS:
            state = ""
            continue
        symbol, strength = lexical[token]
        state, scope = SCOPE[state, symbol]
        if scope:
            found.add(f"{'insult' if symbol == 'I' else 'threat'}{strength}/{scope}")
    return found


def matches_of(texts: list[str | None], model: Model) -> list[set[str]]:
    """The matches of each text; each distinct word of the batch passes the lexical transducer once."""
    tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    flat = np.array([w for t in tokens for w in t], dtype=object)
    if not len(flat):
        return [set() for _ in texts]
    codes, uniques = pd.factorize(flat)
    lexical = {w: model.lexical(w) for w in uniques}
    hit = np.array([lexical[w][0] in "IH" for w in uniques])[codes]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    counts = np.concatenate([[0], np.cumsum(hit)])
    has = counts[bounds[1:]] > counts[bounds[:-1]]
    return [clause_matches(t, lexical) if h else set() for t, h in zip(tokens, has, strict=True)]


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, max_toxic: int, max_clean: int) -> DataFrame:
    """(text, toxic, fold) of a bounded sample of labelled rows, chosen by a hash of the id. Of conflicting labels 1 wins."""
    known = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("toxic")).where(
        (F.col("toxic").isin(0, 1)) & F.col("id").isNotNull() & (_fold(F.col("id")) != 0)
    )
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, most / max(1, sizes.get(k, 0))) for k, most in ((0, max_clean), (1, max_toxic))]
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1_000_000))
    chosen = known.where(draw < F.when(F.col("toxic") == 1, share[1] * 1e6).otherwise(share[0] * 1e6))
    rows = docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text")).where("text IS NOT NULL")
    # The draw holds about max_toxic + max_clean ids whatever the size of the corpus, so ids travel and texts stay.
    return rows.join(F.broadcast(chosen), "id").select("text", "toxic", _fold(F.col("id")).cast("int").alias("fold"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
) -> Model:
    """Learn the weights. Without rows of both labels the model has no entry, and scores are those of its prior."""
    rows = stored(training_rows(docs, labels, text, doc_id, label, max_toxic, max_clean), "labelled")
    sizes = {(r["toxic"], r["part"]): r["n"] for r in rows.groupBy("toxic", (F.col("fold") == 4).alias("part")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if not n_toxic or not n_clean:
        return Model(prior=math.log((n_toxic + 1) / (n_clean + 1)))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        toxic = part.column(1).to_pylist()
        found = [(w, y) for t, y in zip(part.column(0).to_pylist(), toxic, strict=True) for w in set(TOKEN.findall(t.lower())) - ENDS]
        frame = pd.DataFrame(found, columns=["word", "toxic"])
        summed = frame.groupby("word")["toxic"].agg(["sum", "size"]).reset_index()
        return pa.RecordBatch.from_arrays(
            [pa.array(summed["word"], pa.string()), pa.array(summed["sum"], pa.int64()), pa.array(summed["size"], pa.int64())],
            names=["word", "n_toxic", "n"],
        )

    words = map_slices(rows.where("fold != 4").select("text", "toxic"), count, "word string, n_toxic bigint, n bigint")
    words = words.groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))
    stems = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]
    entries = words.select(F.explode(F.array(F.concat("word", F.lit("$")), *stems)).alias("entry"), "n_toxic", "n")
    entries = entries.where("entry IS NOT NULL").groupBy("entry").agg(F.sum("n_toxic").alias("t"), F.sum("n").alias("n"))
    weight = F.log(F.col("t") / n_toxic) - F.log((F.col("n") - F.col("t") + 3) / (n_clean + 6))
    chosen = entries.where(F.col("t") >= LEAST_ROWS).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    # every entry that qualifies; each needs several rows of the bounded sample
    lexicon = {r["entry"]: r["weight"] for r in chosen.collect()}
    return _weigh(rows.where("fold = 4"), Model(lexicon=lexicon), (n_toxic, n_clean))


def _weigh(rows: DataFrame, model: Model, seen: tuple[int, int]) -> Model:
    """Log odds of each kind of match, from rows that did not choose the lexicon."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def match(part: pa.RecordBatch) -> pa.RecordBatch:
        found = matches_of(part.column(0).to_pylist(), shared.value)
        flat = [(m, y) for ms, y in zip(found, part.column(1).to_pylist(), strict=True) for m in {*(ms or {NONE}), ""}]
        name, toxic = zip(*flat, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(toxic, pa.int64())], names=["match", "toxic"])

    rows = map_slices(rows.select("text", "toxic"), match, "match string, toxic bigint")
    counts = {r["match"]: (r["t"], r["n"] - r["t"]) for r in rows.groupBy("match").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    toxic, clean = counts.pop("", (0, 0))
    ratio = lambda t, n: math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
    model.weights = {m: ratio(t, n) for m, (t, n) in counts.items()}
    model.prior = math.log((seen[0] + toxic + 1) / (seen[1] + clean + 1))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", **keep: Column) -> DataFrame:
    """`keep` columns with score and matches (distinct, ascending) for every row; null and empty texts have no match."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[v.alias(k) for k, v in keep.items()], col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = matches_of(part.column(part.num_columns - 1).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays(
            [
                *part.columns[:-1],
                pa.array([shared.value.score(m) for m in found], pa.float64()),
                pa.array([sorted(m) for m in found], pa.list_(pa.string())),
            ],
            names=[*part.schema.names[:-1], "score", "matches"],
        )

    return map_slices(source, work, f"{schema}, score double, matches array<string>")
