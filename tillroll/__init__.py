"""Receipt cleaning, labelling, classification and reporting as Spark jobs."""
