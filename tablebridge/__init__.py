"""tablebridge: moving, changing and proving tables with Spark."""
