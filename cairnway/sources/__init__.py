"""Table readers and the trail-shaped views over them."""
