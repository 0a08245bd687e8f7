"""Saving and loading of pipeline stages that hold other stages or functions."""

from __future__ import annotations

import importlib
import json

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class Nested(MLWritable, MLReadable):
    """A stage whose settings are attributes: ``CHILDREN`` hold stages or lists of stages, ``PLAIN`` JSON values.

    The constructor takes both by name. Params are saved as well.
    """

    CHILDREN: tuple[str, ...] = ()
    PLAIN: tuple[str, ...] = ()

    def write(self) -> MLWriter:
        """Writer of this stage and the stages in it."""
        return _NestedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        """Reader of such a stage."""
        return _NestedReader(cls)


class _NestedWriter(MLWriter):
    def __init__(self, instance: Nested):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        stage = self.instance
        counts = {}
        for name in stage.CHILDREN:
            held = getattr(stage, name)
            many = isinstance(held, (list, tuple))
            counts[name] = len(held) if many else None
            for i, child in enumerate(held if many else [held]):
                child.write().save(f"{path}/{name}-{i}")
        plain = {name: getattr(stage, name) for name in stage.PLAIN}
        extra = {"children": counts, "plain": json.dumps(plain)}
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata=extra)


class _NestedReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)

        def child(name: str, i: int):
            return DefaultParamsReader.loadParamsInstance(f"{path}/{name}-{i}", self.sparkSession)

        settings = {
            name: child(name, 0) if n is None else [child(name, i) for i in range(n)]
            for name, n in metadata["children"].items()
        }
        stage = self.kind(**settings, **json.loads(metadata["plain"]))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def import_path(function) -> str:
    """``module:name`` of a function that a later session can import."""
    path = f"{function.__module__}:{function.__qualname__}"
    if "<" in path or function.__module__ == "__main__":
        raise ValueError(f"only functions of a module can be saved, not {path}")
    return path


def imported(path: str):
    """The function of an import path."""
    module, name = path.split(":")
    found = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found
