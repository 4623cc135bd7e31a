"""hashloom: seeded hash families, mergeable sketches and exact counterparts as Spark plans."""
