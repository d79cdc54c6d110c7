"""Digests of files in memory that does not grow with them.

Spark reads a binary file as one cell, in heap a few times over, and Python
workers reach only stores that they have a client for. So the bytes go from
Hadoop's file system straight into the digests, a block at a time, in a
function of the JVM: a few lines of Java, compiled on the driver by the
compiler that Spark brings for its generated code.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CLASS = "qalam.FileDigests"
SOURCE = """
package qalam;

import java.io.FileNotFoundException;
import java.io.IOException;
import java.io.InputStream;
import java.security.MessageDigest;
import java.util.HexFormat;
import org.apache.hadoop.conf.Configuration;
import org.apache.hadoop.fs.Path;
import org.apache.spark.sql.Column;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.UDF1;
import org.apache.spark.sql.functions;
import org.apache.spark.sql.types.DataType;
import org.apache.spark.util.SerializableConfiguration;

public class FileDigests implements UDF1 {
    private final SerializableConfiguration conf;

    public FileDigests(Configuration conf) {
        this.conf = new SerializableConfiguration(conf);
    }

    /** Null for a file that the session's settings tell Spark's readers to skip. */
    public Object call(Object path) throws Exception {
        try {
            return this.digests((String) path);
        } catch (FileNotFoundException e) {
            if (this.conf.value().getBoolean("spark.sql.files.ignoreMissingFiles", false)) return null;
            throw e;
        } catch (IOException e) {
            if (this.conf.value().getBoolean("spark.sql.files.ignoreCorruptFiles", false)) return null;
            throw e;
        }
    }

    private Row digests(String path) throws Exception {
        MessageDigest md5 = MessageDigest.getInstance("MD5");
        MessageDigest sha1 = MessageDigest.getInstance("SHA-1");
        MessageDigest sha256 = MessageDigest.getInstance("SHA-256");
        byte[] block = new byte[1 << 20];
        Path file = new Path(path);
        InputStream in = file.getFileSystem(this.conf.value()).open(file);
        try {
            for (int n = in.read(block); n >= 0; n = in.read(block)) {
                md5.update(block, 0, n);
                sha1.update(block, 0, n);
                sha256.update(block, 0, n);
            }
        } finally {
            in.close();
        }
        HexFormat hex = HexFormat.of();
        return RowFactory.create(new Object[] {hex.formatHex(md5.digest()), hex.formatHex(sha1.digest()), hex.formatHex(sha256.digest())});
    }

    /** Nondeterministic, so that no plan evaluates it, and reads a file, more than once. */
    public Column of(Column path) {
        DataType kind = DataType.fromDDL("struct<md5:string,sha1:string,sha256:string>");
        return functions.udf((UDF1) this, kind).withName("file_digests").asNondeterministic().apply(new Column[] {path});
    }
}
"""

#: By application: the compiled class, and the folder of its jar, which the driver serves while it lives.
_compiled: dict[str, tuple] = {}


def _class(spark: SparkSession):
    """The function's class; executors get it in a jar, through Spark's own file distribution."""
    sc = spark.sparkContext
    if sc.applicationId not in _compiled:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE)
        folder = tempfile.TemporaryDirectory()
        to = Path(folder.name, "qalam-digests.jar")
        with zipfile.ZipFile(to, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(str(to))
        _compiled[sc.applicationId] = (compiler.getClassLoader().loadClass(CLASS), folder)
    return _compiled[sc.applicationId][0]


def file_digests(spark: SparkSession, path: str) -> Column:
    """``struct<md5, sha1, sha256>`` of the file named by column ``path``, which is read once, in blocks; null for one to skip."""
    values = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 1)
    values[0] = spark._jsparkSession.sessionState().newHadoopConf()
    return Column(_class(spark).getConstructors()[0].newInstance(values).of(F.col(path)._jc))
