"""The ten read operations: arguments are checked, a status is always given, rows stay lazy."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.model import Corpus, FilterSet, apply_filters, overlaps
from palimpsest.operators import citations, history, retrieval, rollups, scd, search, temporal, upkeep
from palimpsest.plans.rules import within_budget

# The closed vocabulary of statuses.
STATUSES = (
    "ok", "no_result", "no_changes_in_period", "profiles_differ", "unknown_work", "unknown_anchor", "unknown_publisher", "no_version_for_date",
    "ambiguous_version", "anchor_not_in_version", "no_provision_history", "text_not_available", "text_withheld", "no_corpus_mounted", "retrieval_mode_unavailable",
)

#: Arguments of each operation: required ones, then optional ones.
ARGUMENTS = {
    "search": (("query",), ("publisher", "jurisdiction", "kind", "language", "act_form", "hierarchy", "binding_status", "domain", "document_role", "publisher_metadata_identifier", "retrieval_mode", "time_scope", "as_of", "works", "limit", "fuzzy")),
    "as_of": (("work", "date"), ("version_key", "publisher", "language", "mode", "anchors")),
    "timeline": (("work",), ("limit", "offset", "publisher")),
    "in_force_on": (("date",), ("publisher", "kind", "language", "limit", "offset")),
    "diff": (("work", "from_date", "to_date"), ("from_version", "to_version", "language", "anchor")),
    "article_history": (("work", "anchor"), ("language", "from", "to")),
    "provenance": (("lex_id",), ("language",)),
    "coverage": ((), ("publisher",)),
    "cited_by": (("work",), ("limit",)),
    "changes_in_period": (("from", "to"), ("publisher", "kind", "language", "order", "limit", "offset")),
}
#: Largest page of each operation.
LIMITS = {"search": 50, "timeline": 200, "in_force_on": 100, "cited_by": 100, "changes_in_period": 100}
#: Characters of text in one answer; provisions that do not fit are told without their text.
TEXT_BUDGET = 250_000
_DATES, _CHOICES = {"date", "from_date", "to_date", "from", "to", "as_of"}, {"mode": ("full", "outline", "select"), "order": ("by_date", "by_churn"), "retrieval_mode": ("keyword", "semantic", "hybrid"), "time_scope": ("all", "as_of", "current")}


class ArgumentError(ValueError):
    """An argument that an operation does not take, or a value that it cannot have."""


@dataclass
class Envelope:
    """The answer of an operation: its status, its rows and what else is to be disclosed."""

    status: str
    rows: DataFrame | None = None
    notes: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.status not in STATUSES:
            raise ValueError(self.status)


def validate(operation: str, arguments: dict) -> dict:
    """The arguments with defaults: closed names, strict ISO dates, bounds, choices and range order."""
    required, optional = ARGUMENTS[operation]
    if unknown := set(arguments) - {*required, *optional}:
        raise ArgumentError(f"{operation} does not take {sorted(unknown)}")
    if missing := [a for a in required if arguments.get(a) in (None, "", ())]:
        raise ArgumentError(f"{operation} needs {missing}")
    out = dict(arguments)
    for name in _DATES & set(out):
        value = str(out[name])
        try:
            ok = re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) and datetime.date.fromisoformat(value)
        except ValueError:
            ok = False
        if not ok:
            raise ArgumentError(f"{name} is not an ISO date: {value}")
    for a, b in (("from", "to"), ("from_date", "to_date")):
        if out.get(a) and out.get(b) and out[a] > out[b]:
            raise ArgumentError(f"{a} is after {b}")
    for name, choices in _CHOICES.items():
        if out.get(name, choices[0]) not in choices:
            raise ArgumentError(f"{name} must be one of {choices}")
    if out.get("mode") == "select" and not out.get("anchors"):
        raise ArgumentError("mode select needs anchors")
    if out.get("time_scope") == "as_of" and not out.get("as_of"):
        raise ArgumentError("time_scope as_of needs as_of")
    if len(out.get("anchors") or ()) > 50:
        raise ArgumentError("at most 50 anchors")
    if "limit" in optional:
        most = LIMITS.get(operation, 100)
        out.setdefault("limit", min(most, {"search": 10, "timeline": 100, "in_force_on": 50, "cited_by": 50, "changes_in_period": 20}.get(operation, most)))
        if not 1 <= int(out["limit"]) <= most:
            raise ArgumentError(f"limit must be from 1 to {most}")
    if int(out.get("offset", 0)) < 0:
        raise ArgumentError("offset must not be negative")
    return out


def _anchor_kind(anchor: str) -> str:
    head = re.match("[A-Za-z]*", anchor)[0].lower()
    return "art" if head.startswith("art") else head


def _anchor_digits(anchor: str) -> str:
    return re.sub("[^0-9]", "", anchor).lstrip("0")


def nearest_anchors(wanted: list[str], held: list[str]) -> list[str]:
    """Anchors to offer for some that are not held: of their kinds and digits, at most ten, else the first six of their kinds.

    All ways to write article are one kind, and leading zeros do not count.  If none of the
    kinds is held, all anchors are offered from.
    """
    kinds, digits = {_anchor_kind(w) for w in wanted} - {""}, {_anchor_digits(w) for w in wanted} - {""}
    family = [a for a in held if _anchor_kind(a) in kinds] or held
    near = [a for a in family if _anchor_digits(a) in digits]
    return near[:10] or family[:6]


class Operations:
    """The operations over one corpus."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def call(self, operation: str, **arguments) -> Envelope:
        arguments = validate(operation, arguments)
        publisher = arguments.get("publisher")
        if publisher is not None:
            names = self.corpus.raw("docs").where("collection <> ''").select("collection").distinct()
            fixed = names.where(F.lower("collection") == publisher.lower()).orderBy("collection").first()
            if fixed is None:
                return Envelope("unknown_publisher", names.orderBy("collection"))
            arguments["publisher"] = fixed["collection"]
        return getattr(self, f"_{operation}")(arguments)

    def _filters(self, a: dict) -> FilterSet:
        as_of = a.get("as_of") if a.get("time_scope") != "all" else None
        if a.get("time_scope") == "current":
            as_of = datetime.date.today().isoformat()
        more = {n: a.get(n) for n in ("hierarchy", "act_form", "binding_status", "domain", "document_role")}
        return FilterSet(a.get("publisher") or a.get("jurisdiction"), a.get("kind"), a.get("language"), tuple(a.get("works") or ()), as_of, metadata_identifier=a.get("publisher_metadata_identifier"), **more)

    def _work(self, argument: str) -> DataFrame:
        parts = argument.split(":")
        slug = parts[1] if len(parts) > 1 and "/" not in argument else argument
        return self.corpus.docs.where((F.col("group_key") == slug) | (F.col("group_identifier") == argument))

    def _as_of(self, a: dict) -> Envelope:
        rows = self._work(a["work"])
        if not rows.take(1):
            return Envelope("unknown_work")
        columns = ("valid_from", "valid_to", "language", "rid", "title", "text_available", "text_public")
        states = temporal.effective_on(rows, a["date"], a.get("language"), columns)
        if a.get("version_key"):
            states = states.where(F.col("key").endswith(":" + a["version_key"]))
        choices = states.limit(21).collect()
        if not choices:
            return Envelope("no_version_for_date")
        if len(choices) > 1:
            return Envelope("ambiguous_version", states, {"choices": [r["key"] for r in choices][:20]})
        state = choices[0]
        gate = "ok" if state["text_public"] else "text_withheld" if state["text_available"] else "text_not_available"
        if gate != "ok":
            return Envelope(gate, states)
        provisions = self.corpus.provisions("ptype", "num", "heading", "path").where(F.col("rid") == state["rid"])
        if a.get("mode") == "outline":
            return Envelope("ok", provisions, {"version": state["key"]})
        if a.get("mode") == "select":
            wanted = list(a["anchors"])
            found = {r[0] for r in provisions.where(F.col("anchor").isin(wanted)).select("anchor").distinct().collect()}  # 50 at most
            missing = [x for x in wanted if x not in found]
            if missing:
                order = provisions.groupBy("anchor").agg(F.min("seq").alias("seq")).orderBy("seq", "anchor")
                digits = F.ltrim(F.regexp_replace("anchor", "[^0-9]", ""), F.lit("0"))
                # the anchors that can be offered: those of the digits asked for, and the first of all
                alike = order.where(digits.isin([_anchor_digits(m) for m in missing])).limit(200).unionByName(order.limit(200)).distinct()
                held = [r["anchor"] for r in alike.orderBy("seq", "anchor").collect()]
                offer = {"missing": missing, "nearest": nearest_anchors(missing, held)}
                if not found:
                    return Envelope("anchor_not_in_version", notes=offer)
                return Envelope("ok", provisions.where(F.col("anchor").isin(wanted)).join(self.corpus.texts, "text_sha", "left"), {"version": state["key"]} | offer)
            provisions = provisions.where(F.col("anchor").isin(wanted))
        texts = provisions.join(self.corpus.texts, "text_sha", "left")
        fits = within_budget(texts.withColumn("size", F.length("text")), "rid", ["seq", "anchor"], "size", TEXT_BUDGET)
        rows = texts.join(fits, ["rid", "seq", "anchor"]).withColumn("text", F.when(F.col("fits"), F.col("text")))
        return Envelope("ok", rows, {"version": state["key"], "withheld_for_size": fits.where("not fits").count()})

    def _timeline(self, a: dict) -> Envelope:
        rows = temporal.timeline(self._work(a["work"]))
        total = rows.count()
        page = rollups.page(rows, [F.col("valid_from"), F.col("key")], a["limit"], int(a.get("offset", 0)))
        return Envelope("ok" if total else "unknown_work", page if total else None, {"total": total, "truncated": total > int(a.get("offset", 0)) + a["limit"]})

    def _in_force_on(self, a: dict) -> Envelope:
        rows = temporal.in_force_on(self.corpus.docs, a["date"], self._filters(a))
        works = rows.select("group_key").distinct()
        page = rollups.page(works, [F.col("group_key")], a["limit"], int(a.get("offset", 0)))
        total = works.count()
        return Envelope("ok" if total else "no_result", rows.join(F.broadcast(page), "group_key"), {"total": total, "population": rollups.population(self.corpus.docs, self._filters(a))})

    def _diff(self, a: dict) -> Envelope:
        rows = self._work(a["work"])
        rids = []
        for day in (a["from_date"], a["to_date"]):
            states = temporal.effective_on(rows, day, a.get("language"))
            if version := a.get("from_version" if not rids else "to_version"):
                states = states.where(F.col("key").endswith(":" + version))
            states = states.limit(2).collect()
            if len(states) != 1:
                return Envelope("no_version_for_date" if not states else "ambiguous_version", notes={"date": day})
            rids.append(states[0]["rid"])
        pair = self.corpus.spark.createDataFrame([tuple(rids)], "from_rid string, to_rid string")
        held = self.corpus.raw("provisions")
        if "profile" in held.columns:
            profiles = held.where(F.col("rid").isin(rids)).groupBy("rid").agg(F.min("profile").alias("profile")).collect()  # two rows
            if len({r["profile"] for r in profiles}) > 1:
                return Envelope("profiles_differ", notes={"profiles": {r["rid"]: r["profile"] for r in profiles}})
        diff = history.version_diff(pair, self.corpus.provisions().where(F.col("rid").isin(rids)))
        if a.get("anchor"):
            diff = diff.where(F.col("anchor") == a["anchor"])
        return Envelope("ok" if diff.take(1) else "unknown_anchor" if a.get("anchor") else "text_not_available", diff, {"from": rids[0], "to": rids[1], "comparable": history.continuity(diff)})

    def _article_history(self, a: dict) -> Envelope:
        docs = self._work(a["work"])
        provisions = self.corpus.provisions("article_valid_from").join(docs.select("rid"), "rid", "left_semi")
        runs = history.wording_runs(docs, provisions)
        if a.get("language"):
            runs = runs.where(F.col("language") == a["language"])
        own = runs.where(F.col("anchor") == a["anchor"])
        if a.get("from") or a.get("to"):
            own = own.where(overlaps(a.get("from") or "0001-01-01", a.get("to") or "9999-12-31"))
        events = history.anchor_events(docs, provisions).where(F.lit(a["anchor"]).isin(F.col("anchor"), F.col("from_anchor"), F.col("to_anchor")))
        if own.take(1):
            return Envelope("ok", own, {"events": events})
        return Envelope("unknown_anchor" if runs.take(1) else "no_provision_history")

    def _provenance(self, a: dict) -> Envelope:
        """The observations of a version, with its events and the stamp of its record."""
        key = a["lex_id"].strip().lower()
        chain = scd.observation_chain(self.corpus.observations).where(F.col("chain") == key)
        if a.get("language"):
            chain = chain.where(F.col("language") == a["language"])
        records = self.corpus.docs.where(F.lower(F.trim("key")) == key)
        events = scd.lifecycle(self.corpus.raw("docs").join(records.select("rid"), "rid", "left_semi"))
        values = F.create_map(*[x for n in ("key", "language", "title", "kind", "record_sha") for x in (F.lit(n), F.col(n))])
        return Envelope("ok" if chain.take(1) else "no_result", chain, {"events": events, "stamp": records.select("rid", upkeep.stamp(values).alias("stamp"))})

    def _coverage(self, a: dict) -> Envelope:
        docs, raw = self.corpus.docs, self.corpus.raw("docs")
        if a.get("publisher") is not None:
            docs, raw = (x.where(F.col("collection") == a["publisher"]) for x in (docs, raw))
        held = docs.where("not withdrawn").groupBy("collection").agg(F.countDistinct("key").alias("held"))
        expected = raw.groupBy("collection").agg(F.countDistinct("key").alias("expected"))
        notes = {c: rollups.coverage_by(docs, c) for c in ("kind", "language")} | {"build": rollups.build_status(held, expected), "gaps": upkeep.acquisition(docs, self.corpus.provisions())}
        return Envelope("ok", rollups.coverage(docs), notes)

    def _cited_by(self, a: dict) -> Envelope:
        slug = a["work"].split(":")[-1] if "/" not in a["work"] else a["work"]
        edges = self.corpus.citations.where((F.col("cited_slug") == slug) | (citations.href_slug(F.col("href")) == slug))
        # either of them names the work here, so that nothing is left to be resolved
        edges = edges.withColumns({"cited_slug": F.lit(slug), "href": F.lit(None).cast("string")})
        rows = citations.cited_by(edges, self.corpus.docs, self.corpus.provisions("num"))
        page = rollups.page(rows, [F.col("valid_from").desc(), F.col("group_key"), F.col("anchor")], a["limit"])
        return Envelope("ok" if page.take(1) else "no_result", page)

    def _changes_in_period(self, a: dict) -> Envelope:
        filters = self._filters(a)
        rows = rollups.changes_in_period(self.corpus.docs, a["from"], a["to"], filters)
        by_churn = a.get("order") == "by_churn"
        order = [F.col("versions").desc(), F.col("last_change").desc()] if by_churn else [F.col("last_change").desc(), F.col("versions").desc()]
        page = rollups.page(rows, [*order, F.col("group_key")], a["limit"], int(a.get("offset", 0)))
        worded = rollups.wording_comparison(page, self.corpus.docs, self.corpus.provisions())
        return Envelope("ok" if page.take(1) else "no_changes_in_period", worded, {"totals": rollups.change_totals(self.corpus.docs, a["from"], a["to"], filters)})

    def _search(self, a: dict) -> Envelope:
        """Hits by stages of evidence (see ``search.staged_search``), two of a work at most unless works were asked for.

        Filters apply before ranking.  If the words of the query are held by fewer than five
        provisions, misspellings are tried as well and come after them.  A semantic search
        needs an encoder, which this corpus has none of.
        """
        if a.get("retrieval_mode", "keyword") != "keyword":
            return Envelope("retrieval_mode_unavailable")
        spark, filters, limit = self.corpus.spark, self._filters(a), a["limit"]
        asked = spark.createDataFrame([(a["query"],)], "query string")
        role = search.query_plans(asked).first()["role"]
        if filters.document_role is not None and role is not None and filters.document_role != role:
            # the query asks for documents of one role and the filter for those of another
            return Envelope("no_result", notes={"role": role})
        docs = apply_filters(self.corpus.docs, filters)
        key, fields = ["group_key", "language", "anchor", "text_sha"], {"work_title": 10.0, "num": 4.0, "heading": 6.0, "text": 1.0}
        states = retrieval.lexical_states(docs, self.corpus.provisions("work_title", "num", "heading")).join(self.corpus.texts, "text_sha", "left")
        hits = search.staged_search(docs, self.corpus.provisions("ptype", "num"), states.select(*key, *fields), asked, 6 * limit)
        notes: dict = {"plan": search.query_plans(asked), "resolutions": search.resolutions(search.query_plans(asked), search.name_records(docs))}
        if a.get("fuzzy", True) and hits.where("stage < 2").count() < 5:
            vocabulary = states.select(F.explode_outer(tx.tokens(F.concat_ws(" ", *fields))).alias("term")).where("term is not null").distinct()
            swaps = retrieval.fuzzy_terms(asked.withColumn("q", F.lit(0)), vocabulary, "q", "query").collect()  # six at most
            notes["expansions"] = [f"{s['word']} -> {s['term']}" for s in swaps]
            for i, s in enumerate(swaps, 1):
                other = asked.select(F.lit(a["query"]).alias("q"), tx.replace_token(tx.fold(F.col("query")), s["word"], s["term"]).alias("query"))
                more = retrieval.bm25(states, other, key, fields, "q", "query", True, limit).withColumnRenamed("q", "query")
                hits = hits.unionByName(more.select("query", *key, F.lit(4 + i).alias("stage"), (F.lit(1000 * i) + F.col("rank")).alias("place")))
        rows = hits.groupBy("query", *key).agg(F.min(F.struct("stage", "place")).alias("b")).select("query", *key, F.col("b.stage").alias("stage"), F.struct("b.stage", "b.place").alias("rank"))
        page = search.shaped(rows, "query", "group_key", "anchor", limit, bool(filters.works)).drop("rank")
        return Envelope("ok" if page.take(1) else "no_result", page, notes)


__all__ = ["ARGUMENTS", "ArgumentError", "Envelope", "Operations", "STATUSES", "nearest_anchors", "validate"]
