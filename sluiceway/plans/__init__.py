"""Batch plans: operators composed into whole jobs."""

from sluiceway.plans.connections import prepare_connections
from sluiceway.plans.csv_flows import prepare_csv_flows
from sluiceway.plans.expert import train_expert
from sluiceway.plans.holdout import stack_leave_one_source_out
from sluiceway.plans.logit_grid import train_logit_grid
from sluiceway.plans.parquet_flows import prepare_flows
from sluiceway.plans.stacking import stack
from sluiceway.plans.vote import train_vote

__all__ = [
    "prepare_connections", "prepare_csv_flows", "prepare_flows", "stack",
    "stack_leave_one_source_out", "train_expert", "train_logit_grid", "train_vote",
]
