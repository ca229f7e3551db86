"""The tables a rule works on, and the joined frames rules share.

A frame takes the members a rule is about and adds the registry (or group) facts its
condition needs. All rules on one frame share one join, whether one rule is listed or all
of them are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from concilia.functions.dates import parse_two_format_date
from concilia.functions.predicates import is_holder
from concilia.functions.prepare import prepare_members, prepare_registry
from concilia.functions.text import is_present, upper_trim
from concilia.operators import groups, matching
from concilia.operators.ledger import AWAITED, active_ids
from concilia.operators.matching import lookup, newest_rows
from concilia.operators.versions import latest_two_distinct, latest_version
from concilia.vocabulary import INACTIVE, REG_ACTIVE, REG_INACTIVE, WAITING


@dataclass(frozen=True)
class Reconciliation:
    """Input tables and the clock. ``as_of`` is an ISO date, ``as_of_ts`` an ISO timestamp."""

    members: DataFrame
    registry: DataFrame
    contracts: DataFrame
    as_of: str
    as_of_ts: str
    ledger: DataFrame | None = None
    sides: Mapping[str, DataFrame] | None = None

    @cached_property
    def day(self) -> Column:
        return F.lit(date.fromisoformat(self.as_of))

    @cached_property
    def moment(self) -> Column:
        return F.to_timestamp(F.lit(self.as_of_ts))

    @cached_property
    def m(self) -> DataFrame:
        return prepare_members(self.members)

    @cached_property
    def r(self) -> DataFrame:
        return prepare_registry(self.registry)

    def with_members(self, members: DataFrame) -> "Reconciliation":
        return replace(self, members=members)

    # -- registry sides: what a frame looks up, of the registry alone --------------------

    def side(self, frame: str) -> DataFrame:
        """The registry side of a frame: the one that is kept, or else its definition."""
        kept = (self.sides or {}).get(frame)
        return getattr(self, f"_side_{frame}")() if kept is None else kept

    def with_sides(self, frames: Iterable[str], keep: Callable[[DataFrame, str], DataFrame]) -> "Reconciliation":
        """The same tables, with the registry sides of these frames as ``keep(df, frame)`` gives
        them. For work that evaluates frames again and again while only members change."""
        there = [frame for frame in frames if hasattr(self, f"_side_{frame}")]
        return replace(self, sides={frame: keep(self.side(frame), frame) for frame in there})

    def _side_by_cco(self) -> DataFrame:
        return newest_rows(self.r, ["r_codcco"])

    def _side_by_cco_full(self) -> DataFrame:
        extra = (
            "r_docident", "r_mae", "r_cns", "r_parentesco", "r_codplaport", "r_codplaope",
        )
        return newest_rows(self.r, ["r_codcco"], *extra)

    def _side_by_trimmed_cco(self) -> DataFrame:
        return newest_rows(self.r, ["r_cco"])

    def _side_by_cpf(self) -> DataFrame:
        extra = ("r_codtit", "r_codplaport", "r_codplaope", "r_cnpj")
        known = self.r.filter(
            F.col("r_cco").isNotNull() & F.col("r_state").isin(REG_ACTIVE, REG_INACTIVE)
        )
        return newest_rows(known, ["r_cpf", "r_state"], *extra)

    def _side_names(self) -> DataFrame:
        named = self.r.filter("r_name <> ''").select(
            "r_codcco", "r_numseq", "r_nomeusu", "r_name"
        )
        return latest_two_distinct(named, ["r_codcco"], "r_name", "r_numseq", "v")

    def _side_births(self) -> DataFrame:
        born = self.r.filter(F.col("r_birth").isNotNull() & F.col("r_name").isNotNull()).select(
            "r_codcco", "r_start", "r_cpf", "r_name", "r_numseq", "r_birth", "r_nascusu"
        )
        same = ["r_codcco", "r_start", "r_cpf", "r_name"]
        return latest_two_distinct(born, same, "r_birth", "r_numseq", "v")

    def _side_codes(self) -> DataFrame:
        coded = self.r.filter(is_present("r_codusu")).select(
            "r_cco", "r_cpf", "r_start", "r_numseq", "r_codusu"
        )
        return latest_version(coded, ["r_cco", "r_cpf", "r_start"])

    def _side_identity(self) -> DataFrame:
        return matching.identities(self.r, "r_sexousu", "r_cns")

    # -- frames: members in, members with facts out ---------------------------------

    def frame(self, name: str, given: Column) -> DataFrame:
        """The frame ``name`` over the rows that satisfy ``given``."""
        return getattr(self, f"_frame_{name}")(given)

    def _frame_members(self, given: Column) -> DataFrame:
        return self.m.filter(given)

    def _frame_by_cco(self, given: Column) -> DataFrame:
        """Newest version of the member's CCO as it is written; members without one stay."""
        return lookup(self.m.filter(given), self.side("by_cco"), {"codcco": "r_codcco"}, "left")

    def _frame_by_cco_full(self, given: Column) -> DataFrame:
        """The same with every registry field that can be compared."""
        return lookup(self.m.filter(given), self.side("by_cco_full"), {"codcco": "r_codcco"}, "left")

    def _frame_by_trimmed_cco(self, given: Column) -> DataFrame:
        return lookup(self.m.filter(given), self.side("by_trimmed_cco"), {"m_cco": "r_cco"}, "inner")

    def _frame_by_cpf(self, given: Column) -> DataFrame:
        """Per status, the newest registry row that has a CCO and the member's CPF."""
        return lookup(self.m.filter(given), self.side("by_cpf"), {"m_cpf": "r_cpf"}, "inner")

    def _frame_names(self, given: Column) -> DataFrame:
        """The newest two differing names of the CCO, and the contract's names."""
        contracts = self.contracts.select(
            F.col("codtit").alias("ct_codtit"), "nometit", "dtope",
            upper_trim("nometit").alias("ct_name"),
        )
        titles = latest_two_distinct(contracts, ["ct_codtit"], "ct_name", "dtope", "t")
        joined = lookup(self.m.filter(given), self.side("names"), {"codcco": "r_codcco"}, "inner")
        joined = lookup(joined, titles, {"codtit": "ct_codtit"}, "left")
        # A member differs from some version / contract name iff it differs from one of two.
        title_differs = (F.col("t1.ct_name") != F.col("m_name")) | F.col("t2").isNotNull()
        holder_differs = is_holder() & F.col("ct_codtit").isNotNull() & title_differs
        differing = F.when(F.col("v1.r_name") != F.col("m_name"), F.col("v1")).otherwise(
            F.col("v2")
        )
        shown_title = F.when(
            holder_differs & (F.col("t1.ct_name") == F.col("m_name")), F.col("t2")
        ).otherwise(F.col("t1"))
        return joined.withColumns({
            "holder_differs": F.coalesce(holder_differs, F.lit(False)),
            "newest_name": F.col("v1"),
            "differing_name": differing,
            "nometit": shown_title.getField("nometit"),
        })

    def _frame_births(self, given: Column) -> DataFrame:
        """Same CCO, start, CPF and name: the newest version with another birth."""
        keys = {"codcco": "r_codcco", "dataini": "r_start", "m_cpf": "r_cpf", "m_name": "r_name"}
        joined = lookup(self.m.filter(given), self.side("births"), keys, "inner")
        return joined.withColumn(
            "other_birth",
            F.when(F.col("v1.r_birth") != F.col("nascusu"), F.col("v1")).otherwise(F.col("v2")),
        ).filter(F.col("other_birth").isNotNull())

    def _frame_codes(self, given: Column) -> DataFrame:
        """Newest registry row with a code, of the same CCO, CPF and start."""
        keys = {"m_cco": "r_cco", "m_cpf": "r_cpf", "dataini": "r_start"}
        return lookup(
            self.m.filter(given), self.side("codes"), keys, "left", when=F.col("situusu") == INACTIVE
        )

    def _frame_identity(self, given: Column) -> DataFrame:
        return matching.with_identities(self.m.filter(given), self.side("identity"))

    def _frame_absent(self, given: Column) -> DataFrame:
        return matching.members_absent_from_registry(self.m.filter(given), self.r)

    def _frame_orphans(self, given: Column) -> DataFrame:
        return matching.registry_without_member(self.r.filter(given), self.m)

    def _frame_duplicate_cco(self, given: Column) -> DataFrame:
        rows = self.m.filter(given)
        keys = groups.duplicate_keys(rows, ["m_cco"]).withColumnRenamed("m_cco", "d_cco")
        return lookup(rows, keys, {"m_cco": "d_cco"}, "inner")

    def _frame_duplicate_cco_keys(self, given: Column) -> DataFrame:
        return groups.duplicate_keys(self.m.filter(given), ["m_cco"])

    def _frame_cpf_groups(self, given: Column) -> DataFrame:
        base = groups.cpf_base(self.m.filter(given))
        stats = groups.cpf_group_stats(base).filter("n > 1")
        return lookup(base, stats, {"empresa": "g_empresa", "cpf": "g_cpf"}, "inner")

    def _frame_cpf_groups_births(self, given: Column) -> DataFrame:
        lists = groups.birth_lists(self.m)
        return lookup(
            self._frame_cpf_groups(given),
            lists,
            {"empresa": "b_empresa", "cpf": "b_cpf"},
            "inner",
        )

    # -- ledger ---------------------------------------------------------------------

    def without_waiting(self, df: DataFrame, rule_id: str) -> DataFrame:
        """Drop members whose correction by this rule still waits for the registry."""
        if self.ledger is None:
            return df
        waiting = active_ids(self.ledger, self.moment, rule_id)
        return lookup(df, waiting, {"id": "cadusu_id"}, "left_anti")

    def unparsed_dates(self) -> DataFrame:
        """Registry dates that are neither blank nor a valid day, by column."""
        pairs = F.explode(F.array(*[
            F.struct(F.lit(name).alias("field"), F.col(name).alias("text"))
            for name in ("nascusu", "dataini", "datafim")
        ]))
        rows = self.registry.select(pairs.alias("p")).select("p.field", "p.text")
        return (
            rows.filter(is_present("text") & parse_two_format_date("text").isNull())
            .groupBy("field")
            .agg(F.count(F.lit(1)).alias("total"))
        )


def without_waiting(ctx: Reconciliation, rows: DataFrame) -> DataFrame:
    """Rows with ``id, rule_id``, less those whose correction waits for the registry."""
    waiting = ctx.ledger.filter(F.col("wait_until") >= ctx.moment)
    waiting = waiting.filter(F.col("status") == WAITING).select(
        "cadusu_id", F.col("rule_id").alias("w_rule")
    )
    return lookup(
        rows, waiting, {"id": "cadusu_id", "rule_id": "w_rule"}, "left_anti",
        when=F.col("rule_id").isin(*AWAITED),
    )
