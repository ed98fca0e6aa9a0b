"""lociweave: categorical-profile (samples x loci) analytics as Spark plans."""
