"""docweave.sources"""
