"""lorekeep: analytics over collections of interlinked text pages, as Spark plans."""
