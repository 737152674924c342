"""Typed, provenance-carrying datasets on Spark DataFrames."""

import warnings as _warnings

from spanweave.dataset import (
    CallSpec, Coupling, Dataset, DatasetContext, FieldHandle, FieldSelection, RowSequence, SourceInfo, UnpicklableCallWarning, active_context, register_exit, register_field_exit, validation,
)
from spanweave.dimensions import AxisWindow, CategoricalDimension, Dimension, IndexDimension, TemporalDimension, interval
from spanweave.functions import anti, distinct, intersect, latest, limit, order_by, sample, semi, subtract
from spanweave.operators import columns as _columns
from spanweave.operators import composition as _composition
from spanweave.operators import groups as _groups
from spanweave.operators import joins as _joins
from spanweave.operators import windows as _windows
from spanweave.operators.arms import (
    OPERATORS, BundleHandle, Operator, Transition, compose_slice_later, map_fields_later, materialize_later, operator, register_aspect_handler, slice_data_later,
)
from spanweave.operators.columns import add_column, assign, make_from_dataframe, table_transform
from spanweave.operators.composition import Bundle, bundle, extract, register_field_policy
from spanweave.operators.groups import Count, Custom, Distinct, Fibers, Max, Mean, Min, ReducingOperator, Sum, map_fibers
from spanweave.operators.joins import ColumnCollision, DimensionJoin, FieldEqualityJoin, IndexJoin, make_plan
from spanweave.operators.windows import array_cut
from spanweave.plans.predicates import MatchPredicate, assert_predicate_contract, equals, overlap
from spanweave.schema import (
    BundleField, CompositeField, CompositeIndexField, DataField, DimensionedSliceField, DimensionField, Field, ForeignIndexField, IndexColumnField, IndexField, IndexIdentity, Schema, ValueField,
)
from spanweave.sources.tables import load, offload, read_table, save

where = operator(Transition(cardinality="filter"))(_columns.where)
keep = operator(Transition(schema="narrow"))(_columns.keep)
drop = operator(Transition(schema="narrow"))(_columns.drop)
rename = operator(Transition(schema="rewrite"))(_columns.rename)
new_field = operator(Transition(schema="extend"))(_columns.new_field)
map_fields = operator(Transition(schema="extend"), columns=map_fields_later)(_columns.map_fields)
consume = operator(Transition(schema="extend"))(_columns.consume)
set_index = operator(Transition(schema="rewrite", identity="mint", independent=False))(_columns.set_index)
reset_index = operator(Transition(schema="rewrite", identity="mint", couplings="clear", independent=False))(_columns.reset_index)
link = operator(Transition(schema="rewrite"))(_columns.link)
pipe = operator(Transition(schema="custom", table="construct", couplings="custom", sources="custom", identity="custom", cardinality="unknown", independent=False))(_columns.pipe)

_PLAN = Transition(schema="construct", table="construct", couplings="clear", sources="compose", identity="mint", cardinality="unknown", independent=False)
join = operator(_PLAN, unary=False)(_joins.join)
dimension_join = operator(_PLAN, unary=False)(_joins.dimension_join)
match = operator(_PLAN, unary=False)(_joins.match)
merge = operator(Transition(schema="compose", table="construct", couplings="derive", sources="compose", identity="inherit", cardinality="unknown", independent=False), unary=False)(_joins.merge)
explode = operator(Transition(schema="compose", table="construct", sources="compose", identity="inherit", cardinality="expand"), unary=False)(_joins.explode)
implode = operator(Transition(schema="construct", table="construct", sources="compose", identity="derive", cardinality="unknown", independent=False), unary=False)(_joins.implode)

_BELOW = Transition(schema="compose", table="construct", couplings="homogeneous", sources="compose", identity="coalesce", cardinality="expand")
concat_rows = operator(_BELOW, unary=False)(_composition.concat_rows)
concat_columns = operator(Transition(schema="compose", table="construct", sources="compose", identity="coalesce", cardinality="unknown", independent=False), unary=False)(_composition.concat_columns)
concat = operator(_BELOW, unary=False)(_composition.concat)

partition = operator(Transition(schema="construct", table="construct", couplings="clear", identity="derive", cardinality="unknown", independent=False))(_groups.partition)
reduce = operator(Transition(schema="construct", table="construct", couplings="clear", identity="derive", cardinality="unknown", independent=False))(_groups.reduce)
flatten = operator(_BELOW, unary=False)(_groups.flatten)

window_expansion_plan = operator(Transition(schema="construct", table="construct", couplings="clear", identity="mint", cardinality="expand"))(_windows.window_expansion_plan)
compose_slice = operator(Transition(schema="extend"), columns=compose_slice_later)(_windows.compose_slice)
slice_data = operator(Transition(), columns=slice_data_later)(_windows.slice_data)
materialize = operator(Transition(), columns=materialize_later)(_windows.materialize)

ColumnCollisionStrategy = ColumnCollision

_OLD_NAMES = {"bind_slice": "slice_data", "bind_dimensions": "compose_slice", "bind_materialize": "materialize"}


def __getattr__(name: str):
    if name in _OLD_NAMES:
        _warnings.warn(f"{name} is now {_OLD_NAMES[name]}", DeprecationWarning, stacklevel=2)
        return globals()[_OLD_NAMES[name]]
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
