"""The package itself, sent to the executors of a session."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

import marlstone

_SENT: set[str] = set()


def ship(spark) -> None:
    """Sends the package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(marlstone.__file__))
    packed = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("marlstone", os.path.relpath(path, root)))
    context.addPyFile(packed)
    _SENT.add(context.applicationId)


def shipped(query):
    """query, the package being sent before it runs; the session is its first argument."""

    @functools.wraps(query)
    def run(spark, *arguments):
        ship(spark)
        return query(spark, *arguments)

    return run
