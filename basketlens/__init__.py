"""Retail price intelligence on Spark: feeds, canonical items, baskets, promotions and data quality as DataFrame jobs."""
