"""Quality rules, line first: lines that fail a rule are removed, documents that lose too much are rejected.

A line is judged if it has a word (a run of anything but space and \\t-\\r). It fails when one of these holds:

    symbols      more than 3 characters of #*$%&|<> in 10 words
    shouting     10 or more ASCII letters, over 7 of 10 in upper case
    marks        more than 3 doubled marks (!! or ??) in 10 words
    navigation   3 or more of the separators | » › ·, and 1 or more in 20 words
    menu         the whole line is an entry of MENU
    boilerplate  it has phrases of BOILERPLATE, and 1 or more (of different ones) in 50 words
    repetition   10 or more words, fewer than 1 in 5 (of more than 500 words, fewer than 100) distinct
    copy         the same line stands earlier in the document
    unfinished   3 to 60 words, the last one ending in a comma, dash, slash or opening bracket
    listing      under 8 words and no end mark, and so are its neighbours: 3 or more such lines in a row

Rules grow with a line's length, so that a text without line ends is not lost by one phrase in it.

A document is rejected when the removed lines hold more than half of its words, or when it fails the base
rules: under 50 words, or more than half of its words in 3-word windows that occur twice or more.

Null and empty texts have no words and are rejected; every repeated row is judged on its own; very long
texts are judged whole; an empty table gives an empty table. What a text does not have anywhere is not looked for in its
lines. Vocabularies may be given (see vocabulary_of). Copies and windows are compared by their text
(lines) or by 64-bit hashes of their words (windows).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import LOWER, WordHashes, by_bytes, id_text, mixed, raw, small_batches, windows_hash

SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "·")
MENU = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "contact", "contact us", "about", "about us",
    "next", "previous", "back", "back to top", "share", "tweet", "print", "sitemap", "help", "faq", "skip to content", "read more",
    "accueil", "connexion", "se connecter", "s'inscrire", "rechercher", "suivant", "retour", "partager", "imprimer", "plan du site", "aide", "lire la suite", "en savoir plus",
    "startseite", "anmelden", "registrieren", "suche", "kontakt", "weiter", "zurück", "nach oben", "teilen", "drucken", "hilfe", "weiterlesen", "mehr erfahren", "impressum",
    "inicio", "iniciar sesión", "registrarse", "buscar", "contacto", "siguiente", "anterior", "volver arriba", "compartir", "imprimir", "ayuda", "leer más", "mapa del sitio",
)
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use of cookies", "uses cookies",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "subscribe to our", "sign up for our", "newsletter",
    "powered by", "page not found", "404 not found", "share this", "follow us on", "leave a comment", "add to cart", "terms and conditions",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "abonnez-vous", "ajouter au panier", "laisser un commentaire",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "klicken sie hier", "folgen sie uns", "in den warenkorb", "kommentar hinterlassen", "seite nicht gefunden",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "utiliza cookies", "haga clic aquí", "suscríbete", "síguenos en", "añadir al carrito", "deja un comentario",
)
#: Characters that a finished line does not end with, and those that end a sentence.
OPEN_ENDS = ",(-/[{"
END_MARKS = ".!?…:;\"')]}»”’。！？"

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_bad_lines long, n_lost_words long"
ARROW = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in COLUMNS.split(", ")])

_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_SYM = [x.encode() for x in SYMBOLS]
_SEP = [x.encode() for x in SEPARATORS]
_MARKS = [b"!!", b"??"]
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_LOWER = bytes(x for x in range(256) if not 97 <= x <= 122)
_OPEN = tuple(x.encode() for x in OPEN_ENDS)
_END = tuple(x.encode() for x in END_MARKS)


class Limits(NamedTuple):
    """What a document may have; the defaults are the production rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50


class Vocabulary(NamedTuple):
    """Entries of menus and phrases of boilerplate, as lower-case (A-Z) UTF-8."""

    menu: frozenset[bytes] = frozenset(x.encode() for x in MENU)
    phrases: tuple[bytes, ...] = tuple(x.encode() for x in BOILERPLATE)


def vocabulary_of(table: DataFrame, most: int = 1_000_000) -> Vocabulary:
    """From a table of (kind, text), kind `menu` or `boilerplate`; at most `most` rows, which every worker holds."""
    rows = table.select("kind", F.lower("text").alias("text")).filter("text <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} entries")
    return Vocabulary(frozenset(r["text"].encode() for r in rows if r["kind"] == "menu"), tuple(sorted(r["text"].encode() for r in rows if r["kind"] == "boilerplate")))


class Present(NamedTuple):
    """Of what rules count, that which a text has at all."""

    symbols: list[bytes]
    separators: list[bytes]
    marks: list[bytes]
    phrases: list[bytes]

    @classmethod
    def of(cls, text: bytes, vocabulary: Vocabulary) -> Present:
        low = text.translate(LOWER)
        return cls(*([x for x in found if x in where] for found, where in ((_SYM, text), (_SEP, text), (_MARKS, text), (vocabulary.phrases, low))))


def line_fails(line: bytes, words: list[bytes], has: Present, menu: frozenset[bytes]) -> bool:
    """Whether a line with words fails a rule that looks at this line alone."""
    n = len(words)
    if has.symbols and 10 * sum(line.count(x) for x in has.symbols) > 3 * n:
        return True
    upper = len(line.translate(None, _NOT_UPPER))
    if upper > 7:
        letters = upper + len(line.translate(None, _NOT_LOWER))
        if letters >= 10 and 10 * upper > 7 * letters:
            return True
    if has.marks and 10 * sum(line.count(x) for x in has.marks) > 3 * n:
        return True
    seps = sum(line.count(x) for x in has.separators) if has.separators else 0
    if seps >= 3 and 20 * seps >= n:
        return True
    if n <= 3 and b" ".join(words).translate(LOWER) in menu:
        return True
    if has.phrases:
        low = line.translate(LOWER)
        phrases = sum(x in low for x in has.phrases)
        if phrases and 50 * phrases >= n:
            return True
    if n >= 10 and 5 * len(set(words)) < min(n, 500):
        return True
    return 3 <= n <= 60 and words[-1].endswith(_OPEN)


class Judged(NamedTuple):
    """The counts of one document, and its text without the lines that failed."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_lines: int
    n_bad_lines: int
    n_lost_words: int
    clean: bytes


def judged(text: bytes, vocabulary: Vocabulary = Vocabulary()) -> Judged:
    has = Present.of(text, vocabulary)
    seen: set[bytes] = set()
    lines = text.split(b"\n")
    lost: dict[int, int] = {}  # line -> words, of the lines that failed
    listing: list[tuple[int, int]] = []  # line, words of the lines without an end mark up to here
    n_lines = n_words = dup = 0

    def close() -> None:
        if len(listing) >= 3:
            lost.update(listing)
        listing.clear()

    for k, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        n = len(words)
        n_lines, n_words = n_lines + 1, n_words + n
        copy = line in seen
        dup += copy
        seen.add(line)
        if n < 8 and not words[-1].endswith(_END):
            listing.append((k, n))
        else:
            close()
        if copy or line_fails(line, words, has, vocabulary.menu):
            lost[k] = n
    close()
    chars = len(text.decode(errors="replace")) - sum(text.count(x) for x in _BLANKS)
    clean = b"\n".join([x for k, x in enumerate(lines) if k not in lost]) if lost else text
    return Judged(n_words, chars, sum(text.count(x) for x in has.symbols), dup, n_lines, len(lost), sum(lost.values()), clean)


def repeat_words(texts: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Of each text, the words in 3-word windows that it has twice or more."""
    words = [x.split() for x in texts]
    h = hashes.of([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    out = np.zeros(len(texts), np.int64)
    if len(h) < 3:
        return out
    inside = doc[2:] == doc[:-2]
    at = np.flatnonzero(inside)
    keys = mixed(windows_hash(h, 3)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = at[counts[back] > 1]
    marked = np.zeros(len(h), bool)
    for k in range(3):
        marked[at + k] = True
    return np.bincount(doc[marked], minlength=len(texts)).astype(np.int64)


def base_failed(n_words: int, n_repeat: int, limits: Limits) -> bool:
    return n_words < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n_words


def is_kept(x: Judged, n_repeat: int, limits: Limits) -> bool:
    return not base_failed(x.n_words, n_repeat, limits) and 100 * x.n_lost_words <= limits.max_lost_percent * x.n_words


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row of counts and verdicts per document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            texts, ids = raw(part.column("text")), part.column("doc_id").to_pylist()
            for a, z in by_bytes(texts, 1_000_000):
                repeats = repeat_words(texts[a:z], hashes).tolist()
                found = [judged(x, vocabulary) for x in texts[a:z]]
                rows = [
                    (i, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, n, base_failed(x.n_words, n, limits), is_kept(x, n, limits), x.n_lines, x.n_bad_lines, x.n_lost_words)
                    for i, x, n in zip(ids[a:z], found, repeats, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return id_text(docs, id_col, text_col).mapInArrow(run, COLUMNS)


def clean_text(text: bytes) -> bytes:
    """The text without the lines that fail a rule."""
    return judged(text).clean


def clean_documents(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """The kept documents with all their columns, their failed lines removed; n_chars follows where it exists."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            texts = raw(part.column(text_col))
            clean: list[bytes] = []
            keep: list[bool] = []
            for a, z in by_bytes(texts, 1_000_000):
                for x, n in zip([judged(x, vocabulary) for x in texts[a:z]], repeat_words(texts[a:z], hashes).tolist(), strict=True):
                    keep.append(is_kept(x, n, limits))
                    clean.append(x.clean)
            k = names.index(text_col)
            part = part.set_column(k, part.schema.field(k), pa.array(clean, pa.binary()).cast(part.schema.field(k).type))
            yield part.filter(pa.array(keep, pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def oracle_sql(limits: Limits = Limits()) -> str:
    """The same rows in SQL."""
    word = r"[^\x20\x09-\x0D]+"
    words = lambda x: f"regexp_extract_all({x}, '{word}')"
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    phrases = f"len(list_filter([{quoted(BOILERPLATE)}], lambda p: contains({low}, p)))"
    menu = quoted(MENU)
    seps = " + ".join(f"(length(line) - length(replace(line, '{x}', '')))" for x in SEPARATORS)
    lowwords = words(low)
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, {words("text")} as ws from d),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as k from (select doc_id, string_split(text, chr(10)) as lines from d)),
m as (
  select doc_id, k, line, {words("line")} as ws, {lowwords} as lws,
         row_number() over (partition by doc_id, line order by k) > 1 as again
  from l where regexp_matches(line, '{word}')
),
o as (
  select *, {phrases} as n_phrases, {seps} as n_seps, len(ws) < 8 and right(ws[-1], 1) not in ({quoted(END_MARKS)}) as is_open from m
), runs as (
  select *, sum(case when is_open then 0 else 1 end) over (partition by doc_id order by k rows unbounded preceding) as run from o
), p as (
  select *, is_open and sum(case when is_open then 1 else 0 end) over (partition by doc_id, run) >= 3 as listed from runs
),
f as (
  select doc_id, len(ws) as n, again,
         again
         or 10 * (length(line) - length(translate(line, '{SYMBOLS}', ''))) > 3 * len(ws)
         or (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 10 and 10 * length(regexp_replace(line, '[^A-Z]', '', 'g')) > 7 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')))
         or 10 * ((length(line) - length(replace(line, '!!', ''))) / 2 + (length(line) - length(replace(line, '??', ''))) / 2) > 3 * len(ws)
         or (n_seps >= 3 and 20 * n_seps >= len(ws))
         or (len(ws) <= 3 and array_to_string(lws, ' ') in ({menu}))
         or (n_phrases > 0 and 50 * n_phrases >= len(ws))
         or (len(ws) >= 10 and 5 * len(list_distinct(ws)) < least(len(ws), 500))
         or (len(ws) between 3 and 60 and right(ws[-1], 1) in ({quoted(OPEN_ENDS)}))
         or listed as bad
  from p
),
ls as (
  select doc_id, count(*) as n_lines, count(*) filter (again) as n_dup, count(*) filter (bad) as n_bad, coalesce(sum(n) filter (bad), 0) as lost
  from f group by doc_id
),
g as (
  select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g) where n > 1),
rw as (select doc_id, count(distinct i + k) as n from r, range(3) t(k) group by doc_id),
s as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
         cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols,
         cast(coalesce(n_dup, 0) as bigint) as n_dup_lines, cast(coalesce(rw.n, 0) as bigint) as n_repeat_words,
         cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_bad, 0) as bigint) as n_bad_lines, cast(coalesce(lost, 0) as bigint) as n_lost_words
  from w left join ls on w.doc_id = ls.doc_id left join rw on w.doc_id = rw.doc_id
), b as (select *, n_words < {limits.min_words} or 100 * n_repeat_words > {limits.max_repeat_percent} * n_words as base_failed from s)
select *, not base_failed and 100 * n_lost_words <= {limits.max_lost_percent} * n_words as kept from b"""
