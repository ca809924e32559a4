"""Eager checkpoints whose cost is measured."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame

from millrace.session import shared_dir

logger = logging.getLogger(__name__)


def checkpoint_timed(df: DataFrame, name: str = "frame") -> tuple[DataFrame, float]:
    """Checkpoint `df` now. Returns the frame that reads the checkpoint, and the seconds it took.

    The seconds include computing `df`. Go on with the returned frame: the one passed in keeps its lineage.
    """
    shared_dir(df.sparkSession)
    start = time.monotonic()
    checkpointed = df.checkpoint(eager=True)
    seconds = time.monotonic() - start
    logger.info("checkpointing %s took %.3f s", name, seconds)
    return checkpointed, seconds
