"""Which source rows made an output row: by pushed predicates, by snapshots, by eager tracking."""

from .answer import Lineage, SourceLineage, eager_lineage, lineage
from .constraints import Constraints, FunctionalDependency, drop_by_key, measure
from .invariants import invariants, violations
from .pushdown import Pushed, push_down
from .snapshot import SnapshotStore, plan_snapshots
from .verify import same_rows, verify_pruning

__all__ = [
    "Constraints", "FunctionalDependency", "Lineage", "Pushed", "SnapshotStore", "SourceLineage", "drop_by_key", "eager_lineage", "invariants", "lineage", "measure", "plan_snapshots", "push_down", "same_rows", "verify_pruning", "violations",
]
