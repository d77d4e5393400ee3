"""URL filter: host and path rules first, then a weighted vocabulary found with Aho-Corasick.

Every url is lower-cased (A-Z) and read once by an automaton over all terms. A hit counts only if the
characters on both sides are not letters or digits. A strict term weighs 1, a soft term its own weight (`weights`, in
hundredths), or 1 / `min_soft` where it has none; a url is blocked when its distinct terms weigh 1 or more: one
strict term, or several distinct soft ones.

Rules and vocabulary can be given as a table (`policy_of`); the default vocabulary covers four languages: heavy words
weigh 0.6, so two of them block, ordinary words 0.4, so it takes three, or one beside a heavy one. The automaton is
built once per worker. Where two rules of one length fit, the first of the list wins.

Null or malformed urls (no "://") have an empty host and path; a null url has no hits and is allowed.
Repeated rows are judged each on their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import lower_az, small_batches

#: Fixed values of the query: (host + path prefix, action).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: A url is blocked when its distinct terms weigh this much (hundredths of a strict term).
LIMIT = 100

#: One is enough: (language or any, terms).
STRICT_TERMS = {
    "any": "porn porno xxx xvideos xhamster hentai camgirls sexcam sexcams adult-x milf warez keygen torrentz phishing malware viagra cialis",
    "en": "escorts escort cheap-pills spam-farm free-bets sportsbook casino-bonus payday-loans fake-ids replica-watches mail-order-brides buy-followers essay-mill",
    "fr": "pornographie videos-x pilules-pas-cher faux-papiers montres-contrefaites",
    "de": "pornofilme sexkontakte billige-pillen gefaelschte-ausweise spielautomaten-tricks",
    "es": "videos-porno pastillas-baratas documentos-falsos relojes-replica contactos-sexo",
}
#: Seldom innocent: two of them, or one and a word of the next list.
HEAVY_TERMS = {
    "any": "adult sex sexy nude nsfw erotic casino poker roulette jackpot betting bets torrent spam webcam blackjack bingo",
    "en": "slots gambling lottery pills weightloss replica giveaway popup ads clickbait hookup singles rehab-scam miracle steroids",
    "fr": "sexe nue erotique paris-sportifs loterie pilules amincissement contrefacon rencontres-coquines machines-a-sous",
    "de": "nackt erotik wetten lotterie gluecksspiel pillen abnehmwunder seitensprung spielautomaten schnellkredit",
    "es": "sexo desnuda erotico apuestas loteria tragaperras adelgazar pastillas falsificado citas-calientes",
}
#: Ordinary words that say little alone: three of them, or one beside a heavier one.
ORDINARY_TERMS = {
    "any": "bonus promo crypto forex gossip",
    "en": "free cheap hot girls dating win winner prize credit loan loans download crack serial click track tracker banner farm drugs pharmacy discount",
    "fr": "gratuit credit-rapide pas-cher gagner rencontres filles pharmacie telecharger",
    "de": "gratis kostenlos billig gewinnen gewinnspiel kredit frauen apotheke",
    "es": "barato ganar premio chicas prestamo farmacia descargar",
}


def _terms(of: dict[str, str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for words in of.values() for x in words.split()))


STRICT, HEAVY, ORDINARY = map(_terms, (STRICT_TERMS, HEAVY_TERMS, ORDINARY_TERMS))
SOFT = HEAVY + ORDINARY
WEIGHTS = tuple((x, 60) for x in HEAVY) + tuple((x, 40) for x in ORDINARY)

SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, n_soft_distinct long, weight double"
ARROW = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_strict", pa.int64()), ("n_soft", pa.int64()), ("n_soft_distinct", pa.int64()), ("weight", pa.float64())])


@dataclass(frozen=True)
class UrlPolicy:
    """Rules and vocabulary; both are bounded lists that a person keeps."""

    rules: tuple[tuple[str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    min_soft: int = 2
    weights: tuple[tuple[str, int], ...] = WEIGHTS
    by_host: dict = field(init=False, compare=False, repr=False, default_factory=dict)

    def __post_init__(self):
        for rule, action in self.rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, action))

    def rule_for(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits the host or a parent domain and begins the path."""
        best, labels = None, host.split(".")
        for k in range(len(labels)):
            for prefix, rule, action in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = rule, action
        return best

    def known(self) -> ahocorasick.Automaton:
        """The automaton, built once per worker process."""
        if _BUILT.get("of") != self:
            _BUILT.update(of=self, automaton=self.automaton())
        return _BUILT["automaton"]

    def weighted(self) -> list[tuple[str, bool, int]]:
        """Term, whether it is strict, and its weight in hundredths; a term that is both is strict."""
        own, usual = dict(self.weights), -(-LIMIT // self.min_soft)
        kinds = {x: (x, False, own.get(x, usual)) for x in self.soft} | {x: (x, True, LIMIT) for x in self.strict}
        return list(kinds.values())

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term in self.weighted():
            found.add_word(term[0], term)
        found.make_automaton()
        return found


#: The policy that this worker used last, and its automaton.
_BUILT: dict = {}


def policy_of(terms: DataFrame, rules: DataFrame | None = None, min_soft: int = 2, most: int = 1_000_000) -> UrlPolicy:
    """A policy from a table (term, strict boolean, and if it likes weight, from 0 to 1) and one of (rule, action, rank);
    terms are lower-cased (A-Z), null and empty ones left out, a term that is both counts as strict, the greatest weight of
    a term counts, and one without weights that are numbers weighs 1 / `min_soft`. A soft term of weight 1 is strict. More
    than `most` terms or rules are an error, for the automaton goes to every worker."""
    weight = F.col("weight").cast("double") if "weight" in terms.columns else F.lit(None).cast("double")
    hundredths = F.when(weight.isNotNull() & ~F.isnan(weight), F.round(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)) * LIMIT).cast("int"))
    clean = terms.select(lower_az(F.col("term")).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), hundredths.alias("weight")).filter("term <> ''").groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight"))
    found = clean.withColumn("strict", F.col("strict") | F.coalesce(F.col("weight") >= LIMIT, F.lit(False))).limit(most + 1).toArrow().to_pylist()
    ranked = rules.filter("rule is not null and action in ('allow', 'block')").orderBy("rank", "rule").select("rule", "action").limit(most + 1).toArrow().to_pylist() if rules is not None else []
    if max(len(found), len(ranked)) > most:
        raise ValueError(f"more than {most} terms or rules")
    of = lambda strict: tuple(sorted(x["term"] for x in found if x["strict"] == strict))
    weights = tuple(sorted((x["term"], x["weight"]) for x in found if x["weight"] is not None and not x["strict"]))
    return UrlPolicy(tuple((x["rule"], x["action"]) for x in ranked) if rules is not None else RULES, of(True), of(False), min_soft, weights)


def counted(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int, int]:
    """Strict hits, soft hits, distinct soft terms and the weight of all distinct terms of a lower-cased url."""
    strict, soft, kinds, n = 0, 0, {}, len(url)
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    for end, (term, is_strict, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if (start and url[start - 1] in word) or (end + 1 < n and url[end + 1] in word):
            continue
        strict += is_strict
        soft += not is_strict
        kinds[term] = is_strict, weight
    return strict, soft, sum(not s for s, _ in kinds.values()), sum(w for _, w in kinds.values())


def judge_urls(pages: DataFrame, policy: UrlPolicy = UrlPolicy(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per url: page_id, host, path, the rule that decided (or null), verdict and what the vocabulary found."""
    small_batches(pages.sparkSession)
    after = F.regexp_extract(F.col("url"), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.col("url"), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    slim = slim.select("page_id", lower_az(after).alias("host"), path.alias("path"), lower_az(F.col("url")).alias("url"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = policy.known()
        for part in parts:
            hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
            rows: list[tuple] = []
            for host, rest, url in zip(hosts, paths, part.column("url").to_pylist(), strict=True):
                strict, soft, kinds, weight = counted(url, automaton)
                rule = policy.rule_for(host, rest)
                rows.append((rule and rule[0], rule[1] if rule else "block" if weight >= LIMIT else "allow", strict, soft, kinds, weight / LIMIT))
            more = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), part.column("path"), *(pa.array(x, type=ARROW.field(k + 3).type) for k, x in enumerate(more))], schema=ARROW)

    return slim.mapInArrow(run, SCHEMA)


def oracle_sql(policy: UrlPolicy = UrlPolicy()) -> str:
    """The same rows in SQL: a bar on both sides of every other character, so that neighbouring hits share no boundary."""
    rules = ", ".join(f"('{r}', '{a}')" for r, a in policy.rules)
    barred = lambda t: "|" + "".join(c if c.isascii() and c.isalnum() else f"|{c}|" for c in t) + "|"
    terms = ", ".join(f"{{'t': '{barred(t)}', 's': {str(s).lower()}, 'w': {w}}}" for t, s, w in policy.weighted())
    hits = lambda which: f"cast(coalesce(list_sum(list_transform(list_filter(found, lambda x: {which}), lambda x: (length(wide) - length(replace(wide, x.t, ''))) // length(x.t))), 0) as bigint)"
    return f"""
with u as (
  select page_id, coalesce(url, '') as url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
         '|' || regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^a-z0-9])', '|\\1|', 'g') || '|' as wide
  from pages
), r as (select rule, action, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from (values {rules}) v(rule, action)),
best as (
  select u.page_id, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from u join r on (u.host = rh or ends_with(u.host, '.' || rh)) and starts_with(u.path, rp) group by u.page_id
), m as (
  select u.*, best.rule, best.action, list_filter([{terms}], lambda x: contains(wide, x.t)) as found
  from u left join best using (page_id)
), n as (
  select *, {hits("x.s")} as n_strict, {hits("not x.s")} as n_soft, cast(len(list_filter(found, lambda x: not x.s)) as bigint) as n_soft_distinct,
         coalesce(list_sum(list_transform(found, lambda x: x.w)), 0) as parts
  from m
)
select page_id, host, path, rule, coalesce(action, case when parts >= {LIMIT} then 'block' else 'allow' end) as verdict,
       n_strict, n_soft, n_soft_distinct, parts / {float(LIMIT)} as weight
from n"""
