"""A run after edits of its rules: only what the edited keys reach is worked out again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import measures, rules
from ledgerfold.plans.reconcile import Reconciliation
from ledgerfold.session import cut


@dataclass
class Edits:
    """Logs of edits by kind of rule, or none.

    Each has ``key``, ``edit`` (ascending), ``reset`` and the fields of its rule.
    The last edit of a key counts; a reset brings the suggestion back.
    """

    norms: DataFrame | None = None
    categories: DataFrame | None = None
    zones: DataFrame | None = None


def _keys(edits: DataFrame | None, form: DataFrame) -> DataFrame:
    return form.select("key").limit(0) if edits is None else cut(edits.select("key").distinct())


def _marked(frame: DataFrame, keys: DataFrame, on: list[str], mark: str) -> DataFrame:
    """Rows with a flag that tells whether ``keys`` (distinct) has theirs."""
    return frame.join(keys.withColumn(mark, F.lit(True)), on, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


class Edited(Reconciliation):
    """The run ``before`` with edits laid over its rules.

    A group is reached if its zone or category is edited; a target if a reached
    group leaves or enters it; a form row if its target is reached or the norm of
    its category is edited.  Everything else is taken over from the written tables
    of the run before, and what follows from groups and results (unassigned data,
    balance, issues, report) works as in any run.  Edits can be laid over edits.
    """

    def __init__(self, before: Reconciliation, edits: Edits):
        super().__init__(before.inputs)
        self.before, self.edits = before, edits
        for name in ("cube", "form_rows", "norms", "norm_candidates", "category_candidates", "zone_candidates"):
            setattr(self, name, getattr(before, name))

    @cached_property
    def norm_keys(self) -> DataFrame:
        return _keys(self.edits.norms, self.before.norm_mapping)

    @cached_property
    def category_keys(self) -> DataFrame:
        return _keys(self.edits.categories, self.before.category_mapping)

    @cached_property
    def zone_keys(self) -> DataFrame:
        return _keys(self.edits.zones, self.before.zone_mapping)

    @cached_property
    def norm_mapping(self) -> DataFrame:
        overlay = lambda mapping, ruled: rules.overlay_norms(mapping, ruled, self.norms)
        return _remapped(self.before.norm_mapping, self.suggested_norms, self.edits.norms, self.norm_keys, overlay)

    @cached_property
    def category_mapping(self) -> DataFrame:
        return _remapped(
            self.before.category_mapping, self.suggested_categories, self.edits.categories, self.category_keys, rules.overlay_targets
        )

    @cached_property
    def zone_mapping(self) -> DataFrame:
        return _remapped(self.before.zone_mapping, self.suggested_zones, self.edits.zones, self.zone_keys, rules.overlay_targets)

    @cached_property
    def reached_groups(self) -> DataFrame:
        """Groups of edited zones and categories, as they were assigned before."""
        return cut(self._groups_marked().filter("__zone OR __category").drop("__zone", "__category"))

    def _groups_marked(self) -> DataFrame:
        marked = _marked(self.before.assigned, self.zone_keys.withColumnRenamed("key", "zone_key"), ["zone_key"], "__zone")
        return _marked(marked, self.category_keys.withColumnRenamed("key", "category_key"), ["category_key"], "__category")

    @cached_property
    def reassigned(self) -> DataFrame:
        groups = self.reached_groups.select(*[c for c in self.before.assigned.columns if c not in measures.ASSIGNED])
        return cut(measures.assign_targets(groups, self.zone_mapping, self.category_mapping, self.form_rows))

    @cached_property
    def assigned(self) -> DataFrame:
        kept = self._groups_marked().filter("NOT (__zone OR __category)").drop("__zone", "__category")
        return cut(kept.unionByName(self.reassigned))

    @cached_property
    def moved_targets(self) -> DataFrame:
        """Form keys that a reached group left or entered."""
        both = self.reached_groups.unionByName(self.reassigned)
        return cut(measures.parts(both).select(*measures.KEYS).distinct())

    @cached_property
    def reached_rows(self) -> DataFrame:
        """Form rows to be worked out again, with their key and mark of repeats."""
        return cut(self._rows_marked().filter(_reached_row()).select(*self.form_rows.columns, *measures.KEYS, "duplicate"))

    def _rows_marked(self) -> DataFrame:
        marked = _marked(self.before.results, self.moved_targets, measures.KEYS, "__target")
        return _marked(marked, self.norm_keys.withColumnRenamed("key", "category_key"), ["category_key"], "__norm")

    @cached_property
    def results(self) -> DataFrame:
        rows = self.reached_rows
        made_of = self.parts.join(rows.select(*measures.KEYS).distinct(), measures.KEYS, "left_semi")
        named = rows.select(F.col("category_key").alias("key")).distinct()
        norms_of = measures.resolve_norms(self.norm_mapping.join(named, "key", "left_semi"), self.norms)
        anew = measures.results_of(rows, measures.targets(made_of), norms_of)
        kept = self._rows_marked().filter(~_reached_row()).drop("__target", "__norm")
        return cut(kept.unionByName(anew))


def _reached_row() -> Column:
    return F.col("__target") | F.col("__norm")


def _remapped(
    mapping: DataFrame, suggested: DataFrame, edits: DataFrame | None, keys: DataFrame, overlay: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """A mapping with the edited keys taken out and put in again by the rules now in force."""
    if edits is None:
        return mapping
    anew = overlay(suggested.join(keys, "key", "left_semi"), rules.latest(edits))
    return mapping.join(keys, "key", "left_anti").unionByName(anew)
