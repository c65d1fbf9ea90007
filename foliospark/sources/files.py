"""Files of any file system that Spark can reach, by its own client on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Small driver-side files: listing, whole reads, writes that appear at once, renames and removals."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.root = self._fs.Path(root)
        self._system = self.root.getFileSystem(conf)
        self.root = self._system.makeQualified(self.root)
        self._context = self._fs.FileContext.getFileContext(self.root.toUri(), conf)
        self._array = spark.sparkContext._gateway.new_array

    def below(self, name: str) -> Files:
        return Files(self._spark, f"{self.root.toString()}/{name}")

    def path(self, name: str = ""):
        return self._fs.Path(self.root, name) if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none of a folder that is not there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self.path(name)))

    def stamp(self) -> tuple:
        """What tells one state of the files below the root from another: names, lengths and times."""
        if not self.exists():
            return ()
        found, out = self._system.listFiles(self.root, True), []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return tuple(sorted(out))

    def read(self, name: str) -> str:
        stream = self._system.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False) -> bool:
        """Writes a file that appears whole or not at all; False, and nothing changed, if it is there already."""
        part = self.path(f"{name}.{uuid.uuid4().hex}.part")
        out = self._system.create(part)
        try:
            out.write(text.encode())
            out.hsync()
        finally:
            out.close()
        return self._moved(part, self.path(name), replace)

    def rename(self, name: str, to: str, replace: bool = False) -> bool:
        return self._moved(self.path(name), self.path(to), replace)

    def _moved(self, source, target, replace: bool) -> bool:
        kinds = getattr(self._fs, "Options$Rename")
        how = self._array(kinds, 1)
        how[0] = kinds.OVERWRITE if replace else kinds.NONE
        self._system.mkdirs(target.getParent())
        try:
            self._context.rename(source, target, how)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self._system.delete(source, True)
            return False
        return True

    def delete(self, name: str = "") -> None:
        self._system.delete(self.path(name), True)
