"""Quality rules from tokeniser fertility.

Two public vocabularies read each word of a text: one of pieces with byte fallback, and one of bytes made for many languages.
Characters per token of each tell how well the text fits ordinary language, the share of the first's byte-fallback tokens how much of
it that vocabulary doesn't know, and the entropy of its token counts how varied the text is. Each measure has a band for the row's
language, or for the script of its letters where the language has none; a text outside a band is rejected, with the reason. Simple counts of words, symbols, repeated lines
and repeated windows of words come first and can reject by themselves.

Words are `[^\\x20\\x09-\\x0D]+`. Each distinct word of a batch is tokenised once, by the first vocabulary as at the start of a text, by
the second as after a blank. Entropy has a
floor that grows with the logarithm of the tokens up to the band's, as few tokens cannot have more. A text of no known script
whose characters are not mostly letters is rejected, too, if its language has no band.

Defined results for odd input: a null or empty text has no words, counts of 0, a null for each measure and fails the base
rules; a null or unknown language takes its script's band; every row is judged alone, so repeated rows repeat their
result. Other columns are not read unless named in `keep`.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, released, ship, texts

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

#: Least and most characters per token, most byte-fallback share, least token entropy in bits. By language, over the 9,066
#: rows of sf0.1/documents that pass the base rules: the 0.5 % quantile of characters per token and the 0.1 % quantile of
#: entropy, rounded down. Shuffled letters lie below the first, encoded bytes, digits and marks far below. Those rows have up to 2.65
#: characters per token and ordinary prose 2.8 to 3.8, so the upper end only stops what hardly parts into words; no row has
#: a byte-fallback token, so that end is left for names and signs.
LANGUAGE_BANDS = {
    "en": (1.92, 8.0, 0.10, 4.2),
    "de": (1.99, 8.0, 0.10, 4.1),
    "fr": (1.75, 8.0, 0.10, 4.8),
    "es": (1.79, 8.0, 0.10, 4.9),
}
#: Latin is the widest of the languages'. The others' least characters per token are about 0.8 of those of article 1 of the
#: Universal Declaration of Human Rights (ru 2.21, el 0.86, ar 0.90, zh 0.98; he, hi and th 0.78 to 0.98).
SCRIPT_BANDS = {
    "latin": (1.75, 8.0, 0.15, 4.1),
    "cyrillic": (1.75, 6.0, 0.30, 2.5),
    "greek": (0.7, 5.0, 0.50, 2.5),
    "arabic": (0.7, 5.0, 0.60, 2.5),
    "cjk": (0.75, 3.0, 0.80, 2.5),
    "other": (0.2, 1.1, 1.00, 2.0),
}
#: Least characters per token of the second vocabulary: the 0.5 % quantile of the same rows by language, rounded down; of scripts, Latin the
#: least of these and the others 0.8 of that article's (ru 2.81, el 1.69, ar 1.49, zh 0.89).
MULTI_LANGUAGES = {"en": 1.67, "de": 1.68, "fr": 1.55, "es": 1.56}
MULTI_SCRIPTS = {"latin": 1.55, "cyrillic": 2.2, "greek": 1.35, "arabic": 1.15, "cjk": 0.7, "other": 0.2}
#: First and last code points of the scripts' main blocks.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)),
}
#: Share of log2(tokens) that the entropy has to reach at least, up to the band's own floor; 0.47 is the 0.1 % quantile of those rows.
ENTROPY_SHARE = 0.45
_MULTIPLIERS = np.random.default_rng(8).integers(0, 2**63, REPEAT_WINDOW, dtype=np.uint64) | np.uint64(1)
_CACHE_WORDS = 400_000
_models: dict = {}


def _model(path: str | None):
    import public_tokenizers
    import sentencepiece

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        _models[path] = (m, np.array([m.is_byte(i) for i in range(m.get_piece_size())]), {})
    return _models[path]


def _multi(path: str | None):
    """The second vocabulary, and what it has read so far."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _models:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _models[path] = (tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {})
    return _models[path]


def script_of(text: str) -> str:
    """The script with most letters; `other` for none."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {s: sum(int(((points >= a) & (points <= b)).sum()) for a, b in r) for s, r in SCRIPT_RANGES.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def lettered(text: str) -> bool:
    """Whether letters and their marks are half of what is not white space, or more."""
    signs = "".join(text.split())
    return 2 * sum(unicodedata.category(c)[0] in "LM" for c in signs) >= len(signs)


def repeated_words(codes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `window` words that the sequence holds twice or more, its first included."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    wide = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h += (wide[j : j + n] + np.uint64(1)) * _MULTIPLIERS[j]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    alike = np.ones(len(a), np.bool_)
    for j in range(window):  # equal hashes are checked word by word
        alike &= codes[a + j] == codes[b + j]
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.unique(np.concatenate([a[alike], b[alike]]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(data: bytes, codes: np.ndarray) -> tuple[int, int, int]:
    """n_symbols, n_dup_lines, n_repeat_words."""
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return symbols, repeated, repeated_words(codes)


SCHEMA = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()),
    ("token_entropy", pa.float64()), ("multi_tokens", pa.int64()), ("multi_chars_per_token", pa.float64()), ("script", pa.string()), ("reason", pa.string()),
]
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, multi_tokens long, multi_chars_per_token double, script string, reason string"


def verdict(lang: str | None, script: str, tokens: int, chars: int, byte_tokens: int, entropy: float, language_bands: dict, script_bands: dict) -> str | None:
    """Why the text is rejected, or None."""
    least, most, bytes_, floor = language_bands.get(lang) or script_bands.get(script) or script_bands["other"]
    if chars < least * tokens or chars > most * tokens:
        return "chars_per_token"
    if byte_tokens > bytes_ * tokens:
        return "byte_share"
    if entropy < min(floor, ENTROPY_SHARE * np.log2(max(1, tokens))):
        return "token_entropy"
    return None


def multi_verdict(lang: str | None, script: str, tokens: int, chars: int, languages: dict = MULTI_LANGUAGES, scripts: dict = MULTI_SCRIPTS) -> str | None:
    """The same of the second vocabulary."""
    return "multi_chars_per_token" if chars < languages.get(lang, scripts.get(script, scripts["other"])) * tokens else None


def judge(data: list[bytes], langs: list, model_path: str | None = None, language_bands: dict = LANGUAGE_BANDS, script_bands: dict = SCRIPT_BANDS, multi_path: str | None = None) -> list[tuple]:
    model, is_byte, cache = _model(model_path)
    multi, multi_cache = _multi(multi_path)
    words = [d.split() for d in data]
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [w for ws in words for w in ws]
    codes, unique = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, object))
    unknown = [w for w in unique if w not in cache]
    pieces = dict(zip(unknown, model.encode([w.decode() for w in unknown], num_threads=1)))
    ids_of = [pieces[w] if w in pieces else cache[w] for w in unique]
    if len(cache) + len(pieces) <= _CACHE_WORDS:
        cache.update(pieces)
    lengths = np.array([len(x) for x in ids_of], np.int64)
    multi_of = [multi_cache[w] if w in multi_cache else len(multi.encode_ordinary(" " + w.decode())) for w in unique]
    if len(multi_cache) + len(pieces) <= _CACHE_WORDS:
        multi_cache.update(zip(unique, multi_of))
    multi_lengths = np.array(multi_of, np.int64)
    chars = np.array([len(w.decode()) for w in unique], np.int64)
    first = np.cumsum(lengths) - lengths
    every = np.array([i for x in ids_of for i in x], np.int64)
    out, at = [], 0
    for d, ws, lang in zip(data, words, langs):
        own = codes[at : at + len(ws)]
        at += len(ws)
        symbols, lines, repeats = base_counts(d, own)
        word_chars = int(chars[own].sum())
        failed = len(ws) < 20 or 100 * repeats > 30 * len(ws)
        n = lengths[own]
        total = int(n.sum())
        if total == 0:
            out.append((len(ws), word_chars, symbols, lines, repeats, failed, False, 0, None, None, None, 0, None, "other", "base" if failed else "no tokens"))
            continue
        tokens = every[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(total)]
        counts = np.bincount(tokens)
        held = counts[counts > 0].astype(np.float64)
        entropy = float(np.log2(total) - (held * np.log2(held)).sum() / total)
        odd = int(counts[is_byte[: len(counts)]].sum())
        script = script_of(d.decode())
        multi_total = int(multi_lengths[own].sum())
        why = "base" if failed else verdict(lang, script, total, word_chars, odd, entropy, language_bands, script_bands)
        why = why or multi_verdict(lang, script, multi_total, word_chars)
        if why is None and script == "other" and lang not in language_bands and not lettered(d.decode()):
            why = "letters"
        out.append((len(ws), word_chars, symbols, lines, repeats, failed, why is None, total, word_chars / total, odd / total, max(0.0, entropy), multi_total, word_chars / multi_total, script, why))
    return out


def quality(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    model_path: str | None = None,
    language_bands: dict = LANGUAGE_BANDS,
    script_bands: dict = SCRIPT_BANDS,
    multi_path: str | None = None,
) -> DataFrame:
    """The columns `keep` with each text's counts, measures, `kept` and the `reason` of a rejection. One pass, no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(text).alias("q_text"), F.col(lang).cast("string").alias("q_lang"), *[F.col(c).alias(f"k_{c}") for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch.column(0), 4 << 20):
                judged = judge(texts(batch.column(0)[part]), batch.column(1)[part].to_pylist(), model_path, language_bands, script_bands, multi_path)
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*judged), SCHEMA)]
                kept = [batch.column(2 + i)[part] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*keep, *[n for n, _ in SCHEMA]])

    return rows.mapInArrow(released(run), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], COLUMNS]))


def op6_fertility(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def base_counts_of_texts(spark, sf_dir: str) -> DataFrame:
    """What of `op6_fertility` SQL can tell: the counts and the base rules' verdict."""
    return op6_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8),
wins AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 7], chr(0))) AS n FROM starts),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM wins, range(0, 8) r(k) WHERE n > 1 GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
repeated AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(r.n, 0)::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id
"""
