"""What surrounds the tables: contracts and their versions, lineage, migrations, layers, watching and notices."""
