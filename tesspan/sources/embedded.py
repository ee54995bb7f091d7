"""An embedded database (Derby) that all processes of a run open alike.

A Derby database in memory belongs to one process, so tasks on executors don't see what was put in the driver's.  Here the
tables' rows are written by tasks as CSV to the shared folder, the driver's database imports these files and is then backed up
beside them, and the address makes every process that opens it take a copy of the backup into its own memory.  The
copies are for reading; each lasts as long as its process.  The folder in spark.checkpoint.dir has to be mounted.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import shared_path

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def embedded_database(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]]) -> str:
    """The address of a new database with the tables: name -> (rows, columns as in CREATE TABLE, in the order of the rows')."""
    jvm, name, root = spark._jvm, uuid.uuid4().hex, shared_path(spark, "database")
    jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    folder = jvm.org.apache.hadoop.fs.Path
    files = folder(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.getUri().getScheme() != "file":
        raise RuntimeError("an embedded database needs a mounted folder in spark.checkpoint.dir")
    at = folder(root).toUri().getPath()
    jvm.java.lang.Class.forName(DRIVER)
    own = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:memory:{name};create=true")
    try:
        statement = own.createStatement()
        for table, (rows, columns) in tables.items():
            # as both sides have it, an empty field is null and a quoted one a text
            rows.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{table}")
            statement.execute(f"CREATE TABLE {table} ({columns})")
            for part in files.listStatus(folder(f"{root}/{table}")):
                if part.getPath().getName().startswith("part-") and part.getLen():
                    file = f"{at}/{table}/{part.getPath().getName()}"
                    statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{file}', NULL, NULL, 'UTF-8', 0)")
        statement.execute(f"CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE('{at}/backup')")
    finally:
        own.close()
    try:  # Derby says that a database is gone by an error
        jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:memory:{name};drop=true")
    except Py4JJavaError:
        pass
    return f"jdbc:derby:memory:{name};createFrom={at}/backup/{name}"
