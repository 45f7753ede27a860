"""Source files derived from the given tables, one file per row and without a shuffle.

``code_files`` turns each row of ``orders`` into one C or C++ file whose statements are
picked by the row's keys; ``text_files`` takes every document and page as a file, whole.
The same derivation exists as DuckDB SQL in ``oracle_base.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# @b buffer, @s source, @n number; ~ newline
STATEMENTS = [
    "gets(@b);",
    "strcpy(@b, @s);",
    "strcat(@b, @s);",
    'sprintf(@b, "%d", @n);',
    'scanf("%s", @b);',
    "vsprintf(@b, @s, @n);",
    "wcscpy(@b, @s);",
    "printf(@b);",
    'printf("%s", @b);',
    "fprintf(stderr, @b);",
    "syslog(LOG_ERR, @b);",
    "system(@b);",
    "popen(@b, @s);",
    "free(@b);",
    "free(@b); @b = NULL;",
    "free(@b); free(@b);",
    "@b = malloc(@n);",
    "@b = malloc(@n * @s); if (@b) { use(@b); }",
    "@b = calloc(@n, 4);",
    "@b = realloc(@b, @n + @s);",
    "if (access(@b, 0)) { fd = open(@b, 0); }",
    "stat(@b, &st); fd = open(@b, 0);",
    "for (i = 0; i < 9; i++) { @b = malloc(4); }",
    "char @b[64];",
    "memcpy(@b, @s, @n);",
    "memmove(@b, @s, @n);",
    "strncpy(@b, @s, 8);",
    "/* strcpy(@b, @s); */ n = 1;",
    "// gets(@b);",
    'puts("strcpy(x, y)");',
    "if ((@b = malloc(@n)) == NULL) return 1;",
    "/* open~   system(@b); */ n = 2;",
    "",
    "@b = new char[@n];",
    "delete @b;",
    "obj.strcpy(@b);",
    "std::system(@b);",
    "fprintf(log_to(@b, 2), @s);",
    "syslog(4, \"%s\", @b); gets(@b);",
    "@b = new (std::nothrow) char[@n];",
    "obj->next.strcpy(@b);",
    "return malloc(@n);",
    "char *gets(char *@b);",
    "printf(\"a\" \"b\"); // don't gets(@b)",
    "#define COPY(x) strcpy(x, @s)",
    "gets(@b); gets(@b);",
    "scanf(\"%d %s\", &@n, @b); strcpy(@s, @b);",
]
MODULES = ["stdio", "string", "stdlib", "net/io", "my-lib"]
DIRECTORIES = ["src", "lib", "build", "include", "dist", "core"]
EXTENSIONS = [".c", ".h", ".cpp", ".c", ".CC", ".txt", ".c", ".hpp", ".py", ".c"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Texts and regex work come out of a few bytes of a row, so rows are dealt out before they grow."""
    conf = df.sparkSession.conf
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions"))))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, language, code, project"""
    return files_of(spread(order_keys(load(spark, sf_dir, "orders"))))


def order_keys(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))


def arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code_files`` as a stream over the files of the orders table."""
    reader = spark.readStream.schema(load(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet")
    return files_of(spread(order_keys(reader.parquet(sf_dir))))


def files_of(o: DataFrame) -> DataFrame:
    templates = F.array(*[F.lit(s) for s in STATEMENTS])

    def statement(j):
        t = F.element_at(templates, ((F.col("c") * 7 + F.col("o") * 5 + j * j * 3 + j * 11)
                                     % len(STATEMENTS) + 1).cast("int"))
        t = F.replace(t, F.lit("~"), F.lit("\n"))
        t = F.replace(t, F.lit("@b"), F.concat(F.lit("b"), ((F.col("c") + j) % 3).cast("string")))
        t = F.replace(t, F.lit("@s"), F.concat(F.lit("s"), ((F.col("o") + j * 2) % 3).cast("string")))
        return F.concat(F.lit("  "), F.replace(t, F.lit("@n"), F.lit("n")))

    count = (F.col("o") * 3 + F.col("c")) % 12
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), count), statement), "\n")
    module = F.element_at(F.array(*[F.lit(m) for m in MODULES]), (F.col("c") % len(MODULES) + 1).cast("int"))
    code = F.concat(F.lit("#include <"), module, F.lit('.h>\n#include "m'), (F.col("o") % 9).cast("string"),
                    F.lit('.h"\n\nint run_'), F.col("o").cast("string"), F.lit("(int n) {\n"), body, F.lit("\n}\n"))
    extension = F.when(F.col("o") % 5 == 0, ".cpp").when(F.col("o") % 5 == 1, ".h").otherwise(".c")
    path = F.concat(F.lit("/proj"), (F.col("c") % 25).cast("string"),
                    F.when(F.col("o") % 7 == 0, "/safe_").otherwise("/f_"),
                    F.col("o").cast("string"), extension)
    return o.select(path.alias("file_path"),
                    F.when(F.col("o") % 5 == 0, "cpp").otherwise("c").alias("language"),
                    code.alias("code"), (F.col("c") % 25).cast("int").alias("project"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files: file_path, language, code (whole texts)."""
    d = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("/docs/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"),
                 F.lit(".c")).alias("file_path"), F.lit("c").alias("language"),
        F.col("text").alias("code"))
    p = load(spark, sf_dir, "pages").select(
        F.concat(F.lit("/pages/p"), F.col("page_id").cast("string"), F.lit(".cpp")).alias("file_path"),
        F.lit("cpp").alias("language"), F.col("html").alias("code"))
    return d.unionByName(p)


def path_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with skipped directories and foreign extensions mixed in: path, code."""
    o = spread(order_keys(load(spark, sf_dir, "orders")))
    pick = lambda values, key: F.element_at(
        F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    path = F.concat(F.lit("/build/root/proj"), (F.col("c") % 25).cast("string"), F.lit("/"),
                    pick(DIRECTORIES, F.col("o")), F.lit("/f"), F.col("o").cast("string"),
                    pick(EXTENSIONS, F.col("o") + F.col("c")))
    return o.select(path.alias("path"), F.concat(
        F.lit("a"), F.col("o").cast("string"), F.lit("\r\nb\rc\n")).alias("code"))


def remove_tree(files: DataFrame, root: str) -> None:
    """Remove what ``write_tree`` wrote, folder by folder; by the tasks, each with a share of the folders."""
    from ..sources.files import open_store

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            store, base = open_store(root)
            for folder in batch.column(0).to_pylist():
                store.delete_dir(f"{base}/{folder}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    below = F.element_at(F.split("path", "/", 4), 4)
    folders = files.select(F.regexp_extract(below, r"(?s)^(.*)/", 1).alias("folder")).distinct()
    # a folder takes long and its name few bytes: left alone, all names would go to one task
    spread(folders).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    store, base = open_store(root)
    store.delete_dir(base)


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``code`` of each row to its path, whose first two folders become ``root``; by the tasks."""
    from ..sources.files import open_store

    def run(batches):
        import pyarrow as pa

        made = set()
        for batch in batches:
            store, base = open_store(root)
            for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{base}/{path.split('/', 3)[3]}"
                if (folder := at.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(at) as out:
                    out.write(code.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "code").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
