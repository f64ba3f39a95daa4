"""docweave.streaming"""
