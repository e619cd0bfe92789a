"""netloom: network-behaviour analytics as Spark DataFrame transformations."""
