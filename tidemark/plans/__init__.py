from tidemark.plans.config import Cube, Job, Source, job_from_config
from tidemark.plans.job import rebuild_stale, refresh, refresh_batch
from tidemark.plans.warehouse import Warehouse

__all__ = ["Cube", "Job", "Source", "Warehouse", "job_from_config", "rebuild_stale", "refresh", "refresh_batch"]
