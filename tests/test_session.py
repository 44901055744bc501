"""Where work is written, and which database is used."""

from types import SimpleNamespace

import pytest

from tarnlake.plans import database
from tarnlake.session import is_local, work_folder


def fake(**settings):
    values = {k.replace("__", "."): v for k, v in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: values.get(key, default)))


def test_named_folder_is_used_on_a_cluster():
    spark = fake(spark__master="spark://host:7077", spark__checkpoint__dir="hdfs://nn/shared/")
    assert work_folder(spark).startswith("hdfs://nn/shared/tarnlake/")


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="shared by all executors"):
        work_folder(fake(spark__master="yarn"))


def test_local_session_gets_a_folder_of_its_own():
    spark = fake(spark__master="local[4]")
    first, second = work_folder(spark), work_folder(spark)
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_local_is_one_process_only():
    assert is_local(fake(spark__master="local")) and is_local(fake(spark__master="local[*]"))
    assert not is_local(fake(spark__master="local-cluster[2,1,1024]"))
    assert not is_local(fake(spark__master="yarn"))


def test_named_database_is_used():
    spark = fake(
        spark__master="yarn", spark__tarnlake__jdbc__url="jdbc:x://host/db", spark__tarnlake__jdbc__user="someone"
    )
    assert database.connection(spark) == {"url": "jdbc:x://host/db", "user": "someone"}


def test_in_process_database_is_refused_on_a_cluster():
    with pytest.raises(ValueError, match="only visible to local sessions"):
        database.connection(fake(spark__master="yarn"))
    assert database.connection(fake(spark__master="local[2]"))["url"].startswith("jdbc:derby:memory:")
