"""Trail and route analytics as Spark jobs over whole tables."""
