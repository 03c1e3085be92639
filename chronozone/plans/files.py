"""Small files in the store, through Hadoop's file systems, so any scheme that Spark knows works."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


#: Stores whose rename takes one step and fails if the target is there.
EXCLUSIVE = frozenset(("hdfs", "viewfs", "ofs", "abfs", "abfss"))


class Store:
    """Reads, creates and lists files below a folder.

    ``write`` publishes a whole file, and of several writers of one name just one succeeds: by a hard link on a local file
    system, by a rename on those of ``EXCLUSIVE``.  Other stores (s3a, gs) promise neither; there ``write`` refuses, unless the
    session says by ``spark.chronozone.singleWriter`` that nobody else writes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.single_writer = spark.conf.get("spark.chronozone.singleWriter", "false").lower() == "true"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """Publish a file in one step; False if it is there already."""
        scheme = self.fs.getUri().getScheme()
        if scheme != "file" and scheme not in EXCLUSIVE and not self.single_writer:
            raise ValueError(f"{scheme} can't publish a file for one of several writers; set spark.chronozone.singleWriter if there is but one")
        if self.exists(name):
            return False
        temporary, path = self.path(f"{name}.{self.jvm.java.util.UUID.randomUUID()}.tmp"), self.path(name)
        out = self.fs.create(temporary, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if scheme != "file":
                return not self.exists(name) and self.fs.rename(temporary, path)
            local = [self.jvm.java.nio.file.Paths.get(self.fs.makeQualified(p).toUri()) for p in (path, temporary)]
            try:
                self.jvm.java.nio.file.Files.createLink(*local)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                    raise
                return False
            return True
        finally:
            self.fs.delete(temporary, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
