"""The query builder: where, own predicates, stitch, own processors, select, normalize, group, then distribution or sum, in that order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from flowquery import compile as c
from flowquery import extend
from flowquery.operators import aggregates, projection, stitch
from flowquery.path import Item, parse_template


@dataclass(frozen=True)
class FlowQuery:
    """An immutable query; each call returns a new one and ``run`` builds the DataFrame."""

    flows: DataFrame
    predicate: str | None = None
    kept: tuple[str, ...] = ()
    stitched: bool = False
    processed: tuple[str, ...] = ()
    selected: tuple[Item, ...] | None = None
    nulled: tuple[Item, ...] | None = None
    groups: tuple[str, ...] = ()
    distribution: bool = False
    sums: tuple[str, ...] = ()

    def where(self, text: str) -> FlowQuery:
        return replace(self, predicate=text)

    def keep(self, *names: str) -> FlowQuery:
        """Rows for which the user's predicates of these names (``extend.predicate``) hold."""
        return replace(self, kept=self.kept + names)

    def stitch(self) -> FlowQuery:
        return replace(self, stitched=True)

    def process(self, *names: str) -> FlowQuery:
        """Rows made by the user's processors of these names (``extend.processor``)."""
        return replace(self, processed=self.processed + names)

    def select(self, text: str) -> FlowQuery:
        return replace(self, selected=parse_template(text))

    def normalize(self, text: str) -> FlowQuery:
        return replace(self, nulled=parse_template(text))

    def groupby(self, *names: str) -> FlowQuery:
        return replace(self, groups=names)

    def dist(self) -> FlowQuery:
        return replace(self, distribution=True)

    def sum(self, *names: str) -> FlowQuery:
        return replace(self, sums=names)

    def run(self) -> DataFrame:
        df = self.flows
        if self.predicate:
            df = df.where(c.where(df.schema, self.predicate))
        df = extend.keep(df, self.kept)
        if self.stitched:
            df = stitch.stitch(df)
        df = extend.process(df, self.processed)
        if self.selected:
            df = projection.select(df, self.selected)
        if self.nulled:
            df = projection.normalize(df, self.nulled)
        if self.distribution:  # wins over sums
            return aggregates.distribution(df, self.groups)
        if self.sums:
            return aggregates.sums(df, self.groups, self.sums)
        return aggregates.clustered(df, self.groups) if self.groups else df
