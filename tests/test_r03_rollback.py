DATA = "/root/testdata/sf0.001"


def test_rollback_knows_losses_without_the_script(spark):
    """the way forward isn't written a second time to see whether it loses data."""
    from tessera.operators import migration
    from tessera.plans.registry import second_version
    from tessera.sources.synthetic import synthetic_catalog

    c = synthetic_catalog(spark, DATA, keep=True)
    less = c.columns.filter("col_ord % 50 <> 1")
    for target in (c, second_version(c), type(c)(c.tables, less, c.refs, c.indexes, c.keys)):
        assert migration.loses_data(c, target) == migration.is_lossy(migration.migration_statements(c, target))
