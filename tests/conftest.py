import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("shared")
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{at}")
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def xorshift(seed):
    state = seed | 1
    while True:
        state ^= state << 13 & (1 << 64) - 1
        state ^= state >> 7
        state ^= state << 17 & (1 << 64) - 1
        yield state


def dataset(seed, n):
    """The mixed shape of records, edges and index terms that the golden roots are taken over."""
    draw = xorshift(seed)
    word = lambda: next(draw).to_bytes(8, "big")
    rows = {}
    made = []
    for _ in range(n):
        kind = next(draw) % 10
        if kind < 6:
            key = b"d/" + (b"post", b"comment", b"profile", b"inventory-item")[next(draw) % 4] + b"/" + word() + word()
            size = 60 + next(draw) % 341
        elif kind < 9:
            key = b"e/" + (b"follows", b"likes", b"member-of")[next(draw) % 3] + b"/"
            key += b"".join(word() for _ in range(16 + next(draw) % 6))
            size = next(draw) % 17
        else:
            key = b"i/post/title/" + b"".join(word() for _ in range(1 + next(draw) % 8))
            size = 16
        made.append((key, bytes(next(draw) & 255 for _ in range(size))))
    for key, value in sorted(made):
        rows.setdefault(key, value)
    return sorted(rows.items())
