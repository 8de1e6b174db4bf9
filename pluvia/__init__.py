"""Rain events, claim links and impact models over gridded precipitation, as Spark jobs."""
