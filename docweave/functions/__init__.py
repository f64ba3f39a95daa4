"""docweave.functions"""
