"""The training-data pipeline, for the check tool: its stages are in the package."""

from evigrain.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
