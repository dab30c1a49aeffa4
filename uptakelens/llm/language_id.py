"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is
parsed from left to right into the longest phrases that occur in the sample: the automaton is
followed as long as it has a transition, and where it has none a phrase ends and the next begins.
A language whose sample has N symbols and which needs c phrases for n symbols has the entropy
c * log2(N) / n, that is phrases normalised by what a phrase costs; the lowest wins, ties go to
the language whose name comes first.

Symbols are the bytes of the text with A-Z in lower case, and every run of other ASCII characters
as one gap. Whole texts are parsed, in stretches of STRETCH symbols at the end of which a phrase
ends too. All stretches of a batch move through the automata of all languages in step, as arrays.

Texts that are null or have no letter are `und` with score 0; so is every text if nothing could
be learned. Rows with a null language or text teach nothing. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm import ragged
from uptakelens.llm.tables import training_fold, unused

#: The sample: about so many texts per language (chosen by the hash of their id), so many
#: characters from a place (chosen likewise) in each, and so many bytes of these at most.
SAMPLE_TEXTS = 80
SAMPLE_CHARS = 400
#: A text of so many symbols is in no language that needs so many phrases for each of them.
ENOUGH = 40
FOREIGN = 0.9
SAMPLE_BYTES = 24_000
STRETCH = 512
#: How quickly the score rises with the distance between entropies.
SHARPNESS = 12.0


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as symbols, and where each text begins among them."""
    data = ragged.lowered(data)
    gap = (data < 128) & ((data < 97) | (data > 122))
    data = np.where(gap, np.uint8(32), data)
    again = np.zeros(len(data), bool)
    again[1:] = gap[1:] & gap[:-1]
    again[at[:-1][at[:-1] < len(data)]] = False
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~again, out=kept[1:])
    return data[~again], kept[at]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the beginning."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        state = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and symbol not in move[p]:
            move[p][symbol] = state
            p = link[p]
        if p != -1:
            q = move[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and move[p].get(symbol) == q:
                    move[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return move


@dataclass(frozen=True)
class LanguageModel:
    """Sample of each language, in the order of their names, as symbols."""

    languages: tuple[str, ...]
    samples: tuple[bytes, ...]


@dataclass(frozen=True)
class Automata:
    """All automata in one table: entry (state, letter) is twice the next state, plus one where
    a phrase ended before the letter. Letter 0 stands for the bytes that no sample has."""

    letter: np.ndarray
    table: np.ndarray
    width: int
    roots: np.ndarray
    cost: np.ndarray


def automata(model: LanguageModel) -> Automata:
    """Built once in each worker process from the samples, which is all that is sent."""
    return ragged.held(("automata", model), lambda: _built(model))


def _built(model: LanguageModel) -> Automata:
    used = sorted(set(b"".join(model.samples)))
    letter = np.zeros(256, np.int64)
    letter[used] = np.arange(1, len(used) + 1)
    width, tables, roots, first = len(used) + 1, [], [], 0
    for sample in model.samples:
        moves = suffix_automaton(sample)
        table = np.full((len(moves) + 1, width), -1, np.int32)
        for state, move in enumerate(moves):
            for symbol, target in move.items():
                table[state, letter[symbol]] = 2 * (target + first)
        # An unknown letter is a phrase of its own and leads to one more state, from which every
        # letter begins a phrase, as it does where there is no transition.
        alone = 2 * (len(moves) + first)
        anew = np.where(table[0] >= 0, table[0], alone)
        table[0] = anew
        table = np.where(table >= 0, table, anew + 1)
        tables.append(table)
        roots.append(first)
        first += len(moves) + 1
    cost = np.array([np.log2(max(2, len(s))) for s in model.samples])
    return Automata(letter, np.concatenate(tables).ravel(), width, np.array(roots), cost)


def phrases(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language, and the number of its symbols."""
    auto, n_languages = automata(model), len(model.languages)
    data, at = symbols(*ragged.utf8(column))
    size = np.diff(at)
    pieces = -(-size // STRETCH)
    text = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = at[:-1][text] + number * STRETCH
    length = np.minimum(STRETCH, at[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    text, begin, length = text[order], begin[order], length[order]
    letters = auto.letter[data]
    count = np.ones((n_languages, len(text)), np.int32)
    state = np.repeat(auto.roots[:, None], len(text), 1).astype(np.int64)
    active = np.searchsorted(-length, -np.arange(1, STRETCH + 1), "right")
    for step in range(int(length[0]) if len(length) else 0):
        k = active[step]
        entry = auto.table[state[:, :k] * auto.width + letters[begin[:k] + step]]
        count[:, :k] += entry & 1
        state[:, :k] = entry >> 1
    total = np.stack([np.bincount(text, row, len(size)) for row in count], 1)
    return total, size


def entropies(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """Cross-parsing entropy, in bits a symbol, of each text (rows) in each language."""
    total, size = phrases(model, column)
    return total * automata(model).cost / np.maximum(size, 1)[:, None]


_RESULT = pa.struct([("language", pa.string()), ("score", pa.float64())])


def predictions(model: LanguageModel, column: pa.Array) -> pa.Array:
    """Language and score of every text: the share of the best among weights that fall
    with the distance of an entropy from the lowest."""
    names, scores = [], []
    for some in ragged.slices(column):
        bits = entropies(model, some)
        best = bits.min(1, keepdims=True)
        weight = np.exp(-SHARPNESS * (bits / np.maximum(best, 1e-9) - 1))
        names.append(bits.argmin(1))
        scores.append(weight.max(1) / weight.sum(1))
    ragged.released()
    if not names:
        return pa.array([], _RESULT)
    language = pa.array(model.languages, pa.string()).take(pa.array(np.concatenate(names)))
    return pa.StructArray.from_arrays(
        [language, pa.array(np.concatenate(scores))], fields=list(_RESULT)
    )


def train(docs: DataFrame, fold: str = "true") -> LanguageModel:
    """Samples of the labelled texts (doc_id, text, lang) for which `fold` holds."""
    labelled = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL").filter(fold)
    rows = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return LanguageModel((), ())
    rate = F.create_map(*(F.lit(x) for k, n in rows.items() for x in (k, min(1.0, SAMPLE_TEXTS / n))))
    draw = "pmod(xxhash64(doc_id), 1000003)"
    place = f"1 + pmod(xxhash64(doc_id, 1), greatest(length(text) - {SAMPLE_CHARS}, 0) + 1)"
    sample = (
        labelled.filter(F.expr(draw) < 1000003 * rate[F.col("lang")])
        .selectExpr("lang", f"substring(text, int({place}), {SAMPLE_CHARS}) AS piece", "xxhash64(doc_id, 2) AS o")
        .filter(r"piece rlike '\\p{L}'")
        .collect()
    )
    samples = {}
    for lang in sorted({r[0] for r in sample}):
        own = [r[2] for r in sorted((r[2], r[1], r[1]) for r in sample if r[0] == lang)]
        data, at = symbols(*ragged.utf8(pa.array(own, pa.string())))
        text = b" ".join(data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False))
        samples[lang] = text[:SAMPLE_BYTES]
    return LanguageModel(tuple(samples), tuple(samples.values()))


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score; columns of these names are replaced."""
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    def predict(column: pa.Array) -> pa.Array:
        return predictions(model, column)

    udf = F.arrow_udf(predict, "struct<language:string,score:double>")
    name = unused("found", docs.columns)
    found = docs.withColumn(name, F.struct(lettered.alias("ok"), udf(text).alias("by")))
    return found.withColumns(
        {
            "lang_pred": F.expr(f"if({name}.ok, {name}.by.language, 'und')"),
            "score": F.expr(f"if({name}.ok, {name}.by.score, 0D)"),
        }
    ).drop(name)


def told(model: LanguageModel, column: pa.Array) -> pa.Array:
    """Whether a text is in one of the languages, as far as its phrases tell: in the language that
    needs fewest it has less than FOREIGN phrases for each symbol, so more in common than letters.
    Texts of fewer symbols than ENOUGH have the benefit of the doubt."""
    out = []
    for some in ragged.slices(column):
        total, size = phrases(model, some)
        out.append((size < ENOUGH) | (total.min(1) < FOREIGN * size))
    ragged.released()
    return pa.array(np.concatenate(out) if out else np.zeros(0, bool))


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents in a language that the model knows. Those without a letter go, and those that
    are in none of the languages (see `told`)."""
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    if not model.languages:
        return lettered.filter("false")

    def known(column: pa.Array) -> pa.Array:
        return told(model, column)

    return lettered.filter(F.arrow_udf(known, "boolean")("text"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a quarter is held out."""
    own = docs.select("doc_id", "text", "lang")
    model = train(own, training_fold())
    held = F.expr(f"NOT {training_fold()}").alias("held_out")
    return with_language(own, model).select("doc_id", held, "lang_pred", "score")
