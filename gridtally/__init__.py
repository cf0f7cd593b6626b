"""Dataset popularity, replica advice and resource use from data-access records."""

from .operators.accounting import flatten_buckets, site_accounting
from .operators.extracts import prepared_extract, subset_extract, training_extract
from .operators.frequency import (
    advice_by_project,
    dataset_frequency,
    frequency_for_list,
    interval_access,
    place_shares,
    placement,
    replication_advice,
)
from .operators.overview import overall_popularity
from .operators.popular import keep_popular, most_popular, multi_user
from .operators.rolling import advice_outcome, rolling_advice, rolling_calendar
from .operators.storage import (
    inventory_and_processing,
    processed_by_site,
    replica_inventory,
    storage_locality,
    with_local_flag,
)
from .operators.tasks import task_execution
from .operators.utilisation import (
    cloud_report,
    metric_pivot,
    pivot_wide,
    site_metrics,
    site_report,
    with_fractions,
)
from .operators.validation import next_period_validation, train_split
from .sources.upsert import clean_batch, keyed_documents, replace_by_task

__all__ = [
    "advice_by_project",
    "advice_outcome",
    "clean_batch",
    "cloud_report",
    "dataset_frequency",
    "flatten_buckets",
    "frequency_for_list",
    "interval_access",
    "inventory_and_processing",
    "keep_popular",
    "keyed_documents",
    "metric_pivot",
    "most_popular",
    "multi_user",
    "next_period_validation",
    "overall_popularity",
    "pivot_wide",
    "place_shares",
    "placement",
    "prepared_extract",
    "processed_by_site",
    "replace_by_task",
    "replica_inventory",
    "replication_advice",
    "rolling_advice",
    "rolling_calendar",
    "site_accounting",
    "site_metrics",
    "site_report",
    "storage_locality",
    "subset_extract",
    "task_execution",
    "train_split",
    "training_extract",
    "with_fractions",
    "with_local_flag",
]
