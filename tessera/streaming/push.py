"""A client for sources that push: messages are spooled into files, which a stream reads in order of arrival."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


class Spool:
    """Listener with the callbacks of a push client. Messages are kept until `size` have come or flush() is called.

    A file is written beside the folder and moved into it, so a stream never sees half of one. After an error
    the client may connect again and go on with the same spool.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = 1000):
        self.spark, self.folder, self.size, self.held, self.errors = spark, folder.rstrip("/"), size, [], []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(self.folder))

    def on_data(self, message: str) -> bool:
        self.held.append(message.replace("\n", " "))
        if len(self.held) >= self.size:
            self.flush()
        return True

    def on_error(self, status: object) -> bool:
        """Keeps what has come and tells the client to stay connected."""
        self.errors.append(status)
        self.flush()
        return True

    def flush(self) -> None:
        if not self.held:
            return
        name = uuid4().hex
        out = self._files.create(self._path(f"{self.folder}/.{name}"))
        out.write("".join(m + "\n" for m in self.held).encode())
        out.close()
        self._files.rename(self._path(f"{self.folder}/.{name}"), self._path(f"{self.folder}/{name}.txt"))
        self.held = []


def spooled(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the spool's messages, (value), a file a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.txt").text(folder)
