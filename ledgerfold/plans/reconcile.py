"""The whole reconciliation: landed grids in, filled form and its proof out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import checks as C
from ledgerfold.operators import match, measures, norms, registry, rules, template
from ledgerfold.session import cut


@dataclass
class Inputs:
    """Landed inputs; rule tables are optional."""

    registry: DataFrame
    form: DataFrame
    order: DataFrame
    norm_rules: DataFrame | None = None
    category_rules: DataFrame | None = None
    zone_rules: DataFrame | None = None
    registry_layouts: DataFrame | None = None
    registry_top: DataFrame | None = None
    norm_layouts: DataFrame | None = None


class Reconciliation:
    """Lazily built relations of one run.

    The registry is scanned once, into ``cube``.  What several results are built
    from is small by then and is checkpointed, so that a lost executor costs a
    read and not a recomputation of the scan or of the matching.
    """

    def __init__(self, inputs: Inputs):
        self.inputs = inputs

    @cached_property
    def registry_layout(self) -> DataFrame:
        return registry.layouts(self.inputs.registry, self.inputs.registry_layouts, self.inputs.registry_top)

    @cached_property
    def unread_files(self) -> DataFrame:
        return registry.unread_files(self.inputs.registry, self.registry_layout)

    @cached_property
    def unread_names(self) -> DataFrame:
        """Names of unread files, by the first rows of the files alone."""
        inputs = self.inputs
        top = inputs.registry.filter(F.col("row_idx") < registry.HEADER_DEPTH) if inputs.registry_top is None else inputs.registry_top
        return registry.unread_files(top, self.registry_layout).select("file", "reason")

    @cached_property
    def cube(self) -> DataFrame:
        return cut(registry.cube_of(self.inputs.registry, self.registry_layout))

    @cached_property
    def groups(self) -> DataFrame:
        return registry.groups(self.cube)

    @cached_property
    def registry_categories(self) -> DataFrame:
        return registry.categories(self.cube)

    @cached_property
    def registry_zones(self) -> DataFrame:
        return registry.zones(self.cube)

    @cached_property
    def registry_totals(self) -> DataFrame:
        return registry.totals(self.cube, self.registry_layout)

    @cached_property
    def form_rows(self) -> DataFrame:
        grids = self.inputs.form
        return cut(template.template_rows(grids, template.template_layout(grids)))

    @cached_property
    def form_categories(self) -> DataFrame:
        return template.template_categories(self.form_rows)

    @cached_property
    def form_zones(self) -> DataFrame:
        return template.template_zones(self.form_rows)

    @cached_property
    def norms(self) -> DataFrame:
        grids, given = self.inputs.order, self.inputs.norm_layouts
        return cut(norms.read_norms(grids) if given is None else norms.apply_layouts(grids, given))

    @cached_property
    def norm_layout_errors(self) -> DataFrame | None:
        """Tables of the order that a given layout names in vain."""
        given = self.inputs.norm_layouts
        return None if given is None else norms.layout_errors(self.inputs.order, given, self.norms)

    @cached_property
    def norm_candidates(self) -> DataFrame:
        wanted = match.norm_names(self.form_categories)
        return cut(match.rank_candidates(wanted, match.norm_pool(self.norms)))

    @cached_property
    def category_candidates(self) -> DataFrame:
        wanted = match.registry_names(self.registry_categories)
        return cut(match.rank_candidates(wanted, match.category_pool(self.form_categories)))

    @cached_property
    def zone_candidates(self) -> DataFrame:
        wanted = match.zone_names(self.registry_zones)
        return cut(match.rank_candidates(wanted, match.zone_pool(self.form_zones)))

    @cached_property
    def suggested_norms(self) -> DataFrame:
        return match.norm_mapping(self.form_categories, self.norm_candidates)

    @cached_property
    def suggested_categories(self) -> DataFrame:
        return match.registry_mapping(self.registry_categories, self.category_candidates)

    @cached_property
    def suggested_zones(self) -> DataFrame:
        return match.zone_mapping(self.registry_zones, self.zone_candidates)

    @cached_property
    def norm_mapping(self) -> DataFrame:
        mapping = self.suggested_norms
        ruled = self.inputs.norm_rules
        return mapping if ruled is None else rules.overlay_norms(mapping, ruled, self.norms)

    @cached_property
    def category_mapping(self) -> DataFrame:
        mapping = self.suggested_categories
        ruled = self.inputs.category_rules
        return mapping if ruled is None else rules.overlay_targets(mapping, ruled)

    @cached_property
    def zone_mapping(self) -> DataFrame:
        mapping = self.suggested_zones
        ruled = self.inputs.zone_rules
        return mapping if ruled is None else rules.overlay_targets(mapping, ruled)

    @cached_property
    def assigned(self) -> DataFrame:
        return cut(measures.assign_targets(self.groups, self.zone_mapping, self.category_mapping, self.form_rows))

    @cached_property
    def parts(self) -> DataFrame:
        return measures.parts(self.assigned)

    @cached_property
    def targets(self) -> DataFrame:
        return measures.targets(self.parts)

    @cached_property
    def norms_of(self) -> DataFrame:
        return measures.resolve_norms(self.norm_mapping, self.norms)

    @cached_property
    def results(self) -> DataFrame:
        return cut(measures.results(self.form_rows, self.targets, self.norms_of))

    @cached_property
    def unassigned(self) -> DataFrame:
        return cut(measures.unassigned(self.assigned, self.parts, self.targets, self.form_rows))

    @cached_property
    def balance(self) -> DataFrame:
        return C.balance(self.groups, self.results, self.unassigned)

    @cached_property
    def checks(self) -> DataFrame:
        return C.checks(self.balance)

    @cached_property
    def issues(self) -> DataFrame:
        return cut(
            C.all_issues(
                self.balance, self.unassigned, self.results, self.norm_mapping, self.norms, self.registry_totals,
                self.unread_names, self.norm_layout_errors,
            )
        )

    @cached_property
    def summary(self) -> DataFrame:
        return C.summary(self.results, self.unassigned, self.issues, self.registry_totals, self.registry_categories)


    def over(self, cube: DataFrame) -> Reconciliation:
        """The same run over another state of the registry cube (a written table).

        Form, norms and their matching don't depend on the registry and are kept;
        so are the candidates of registry names that were matched before, as they
        follow from the name's key and the form alone.  Only new names are matched.
        """
        other = Reconciliation(self.inputs)
        other.cube = cube
        for name in ("form_rows", "norms", "norm_candidates"):
            setattr(other, name, getattr(self, name))
        sides = (
            ("category_candidates", match.registry_names(other.registry_categories), match.category_pool(self.form_categories)),
            ("zone_candidates", match.zone_names(other.registry_zones), match.zone_pool(self.form_zones)),
        )
        for name, wanted, pool in sides:
            known = self.__dict__.get(name)
            if known is None:
                found = match.rank_candidates(wanted, pool)
            else:
                new = wanted.join(known.select("key").distinct(), "key", "left_anti")
                found = known.join(wanted.select("key"), "key", "left_semi").unionByName(match.rank_candidates(new, pool))
            setattr(other, name, cut(found))
        return other


def reconcile(inputs: Inputs) -> Reconciliation:
    return Reconciliation(inputs)
