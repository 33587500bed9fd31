"""Building an index once: steps in order, some of which may fail, under a lease that one builder holds."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quillon.session import created_once


@dataclass(frozen=True)
class Step:
    """A step of a build; one that isn't fatal is reported when it fails, and the next ones go on without it."""

    name: str
    run: Callable[[], None]
    fatal: bool = False
    after: tuple[str, ...] = ()


def ordered(steps: list[Step]) -> list[Step]:
    """The steps, each after those it names, otherwise as given; a circle or an unknown name is a ValueError."""
    names, done, out = {s.name for s in steps}, set(), []
    if any(not set(s.after) <= names for s in steps):
        raise ValueError("a step names one that isn't there")
    while len(out) < len(steps):
        ready = next((s for s in steps if s.name not in done and set(s.after) <= done), None)
        if ready is None:
            raise ValueError("steps wait for each other")
        done.add(ready.name)
        out.append(ready)
    return out


def build_once(spark: SparkSession, folder: str, steps: list[Step], ready: Callable[[], bool], report: Callable[[str], None] = print, patience: float = 3600, poll: float = 0.2) -> str:
    """'ready' if nothing was to be done, 'built' if this call did it, 'waited' if another one did meanwhile.

    The lease is a file in a shared folder, made only where it doesn't exist yet. Whoever gets it looks again whether the
    index is ready, builds, and gives the lease back, also after a failure; the others wait until it is gone. A lease
    older than `patience` seconds, whose builder is lost, is taken over.
    """
    if ready():
        return "ready"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_building")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    began = time.time()
    while not created_once(spark, str(path.toString()), b""):
        if _age(files, path) > patience:
            files.delete(path, False)
            continue
        if time.time() - began > patience:
            raise TimeoutError(f"another build holds {path}")
        time.sleep(poll)
    try:
        if ready():
            return "waited"
        for step in ordered(steps):
            report(step.name)
            try:
                step.run()
            except Exception as error:
                if step.fatal:
                    raise
                report(f"{step.name} failed: {error}")
        return "built"
    finally:
        files.delete(path, False)


def _age(files, path) -> float:
    """Seconds since the lease was made; none where it is gone by now."""
    try:
        return time.time() - files.getFileStatus(path).getModificationTime() / 1000
    except Exception as error:
        if "FileNotFound" in str(error):
            return 0.0
        raise
