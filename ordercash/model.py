"""The order-to-cash data model: table schemas, keys and relationships.

Two models describe the same business. The star model (``STAR``) holds one table per
entity; the document model (``SAP``) holds headers and items under SAP names, with all its
tables and columns. Tables may carry more, and every operator keeps to the columns it
needs, so extra columns are pruned at the scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Tables = Mapping[str, DataFrame]


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "money": T.DecimalType(18, 2),
    "net": T.DecimalType(20, 4),
    "total": T.DecimalType(30, 4),
}

# What a column means, where its name does not say.
_COMMENTS = {
    "star.customers.customer_id": "key of the customer",
    "star.customers.is_blocked": "1 when no further orders are taken",
    "star.orders.order_id": "key of the order",
    "star.orders.delivery_status": "A open, B partial, C complete",
    "star.order_items.line_no": "a number held as text",
    "star.deliveries.delivery_id": "key of the delivery",
    "star.deliveries.ship_date": "day of goods issue",
    "star.deliveries.goods_status": "C once goods have left",
    "star.invoices.invoice_id": "key of the invoice",
    "star.invoices.is_cancelled": "1 when void",
    "star.payments.payment_id": "key of the payment",
    "star.payments.is_incoming": "1 when received",
    "star.products.product_id": "key of the product",
    "star.products.is_deleted": "1 when withdrawn",
    "sap.sales_order_headers.sold_to_party": "customer that placed the order",
    "sap.outbound_delivery_items.reference_sd_document": "the sales order",
    "sap.billing_document_items.reference_sd_document": "the delivery",
    "sap.payments_accounts_receivable.clearing_date": "empty while unpaid",
}


def _table(comment: str, columns: str) -> tuple[str, str]:
    return comment, columns


def _schema(table: str, columns: str) -> T.StructType:
    """A schema from ``name type`` pairs, with each column's comment as its metadata."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        comment = _COMMENTS.get(f"{table}.{name}")
        metadata = {"comment": comment} if comment else None
        fields.append(T.StructField(name, _TYPES[kind], True, metadata))
    return T.StructType(fields)


# Names and types of the star model.
_STAR = {
    "customers": _table(
        "Parties that place orders",
        """customer_id string, name string, grouping string,
        is_blocked int, is_archived int,
        created_date date""",
    ),
    "orders": _table(
        "Sales orders",
        """order_id string, customer_id string, order_type string,
        sales_org string, order_date date, requested_delivery_date date,
        total_amount money, currency string,
        delivery_status string, process_status string""",
    ),
    "order_items": _table(
        "Lines of sales orders",
        """order_id string, line_no string, product_id string,
        quantity money, unit string, net_amount net, plant string,
        item_category string, delivery_status string""",
    ),
    "deliveries": _table(
        "Deliveries made for an order",
        """delivery_id string, order_id string, created_date date,
        ship_date date, picking_status string,
        goods_status string, shipping_point string,
        delivery_block string""",
    ),
    "invoices": _table(
        "Invoices raised for an order",
        """invoice_id string, order_id string, customer_id string,
        invoice_type string, invoice_date date, total_amount total, currency string,
        accounting_doc string, is_cancelled int""",
    ),
    "payments": _table(
        "Money moved to or from a customer",
        """payment_id string, payment_item string, customer_id string,
        clearing_date date, posting_date date, amount money, currency string,
        clearing_doc string, gl_account string, is_incoming int""",
    ),
    "products": _table(
        "Products for sale",
        """product_id string, product_name string,
        product_type string, old_sku string, is_deleted int""",
    ),
}

# Every table and column of the document model. Columns that no operator reads, and
# that are not days or amounts, are text.
_SAP = {
    "billing_document_cancellations": _table(
        "Cancelled invoices",
        """billing_document string, billing_document_type string, creation_date date,
        creation_time string, creation_time_json string, last_change_date_time string,
        billing_document_date date, billing_document_is_cancelled boolean,
        cancelled_billing_document string, total_net_amount total,
        transaction_currency string, company_code string, fiscal_year string,
        accounting_document string, sold_to_party string""",
    ),
    "billing_document_headers": _table(
        "One row per invoice",
        """billing_document string, billing_document_type string, billing_document_date date,
        billing_document_is_cancelled boolean, total_net_amount total,
        transaction_currency string, accounting_document string, sold_to_party string,
        creation_date date, creation_time string, creation_time_json string,
        last_change_date_time string, cancelled_billing_document string,
        company_code string, fiscal_year string""",
    ),
    "billing_document_items": _table(
        "Invoice lines, each naming the delivery it bills",
        """billing_document string, billing_document_item string, material string,
        net_amount net, reference_sd_document string, reference_sd_document_item string,
        billing_quantity string, billing_quantity_unit string, transaction_currency string""",
    ),
    "business_partner_addresses": _table(
        "Addresses of business partners",
        """business_partner string, address_id string, validity_start_date date,
        validity_end_date date, address_uuid string, address_time_zone string,
        city_name string, country string, po_box string,
        po_box_deviating_city_name string, po_box_deviating_country string,
        po_box_deviating_region string, po_box_is_without_number string,
        po_box_lobby_name string, po_box_postal_code string, postal_code string,
        region string, street_name string, tax_jurisdiction string, transport_zone string""",
    ),
    "business_partners": _table(
        "Customers as business partners",
        """business_partner string, customer string, business_partner_name string,
        business_partner_full_name string, business_partner_is_blocked boolean,
        business_partner_grouping string, creation_date date, last_change_date date,
        is_marked_for_archiving boolean, business_partner_category string,
        correspondence_language string, created_by_user string, creation_time string,
        creation_time_json string, first_name string, form_of_address string,
        industry string, last_name string, organization_bp_name1 string,
        organization_bp_name2 string""",
    ),
    "customer_company_assignments": _table(
        "Customers by company code",
        """customer string, company_code string, accounting_clerk string,
        accounting_clerk_fax_number string, accounting_clerk_internet_address string,
        accounting_clerk_phone_number string, alternative_payer_account string,
        payment_blocking_reason string, payment_methods_list string, payment_terms string,
        reconciliation_account string, deletion_indicator string,
        customer_account_group string""",
    ),
    "customer_sales_area_assignments": _table(
        "Customers by sales area",
        """customer string, sales_organization string, distribution_channel string,
        division string, billing_is_blocked_for_customer string,
        complete_delivery_is_defined string, credit_control_area string, currency string,
        customer_payment_terms string, delivery_priority string,
        incoterms_classification string, incoterms_location1 string, sales_group string,
        sales_office string, shipping_condition string,
        sls_unlmtd_ovrdeliv_is_allwd string, supplying_plant string,
        sales_district string, exchange_rate_type string""",
    ),
    "journal_entry_items_accounts_receivable": _table(
        "Receivable lines of journal entries",
        """company_code string, fiscal_year string, accounting_document string,
        accounting_document_item string, gl_account string, reference_document string,
        cost_center string, profit_center string, transaction_currency string,
        amount_in_transaction_currency money, company_code_currency string,
        amount_in_company_code_currency money, posting_date date, document_date date,
        accounting_document_type string, assignment_reference string,
        last_change_date_time string, customer string, financial_account_type string,
        clearing_date date, clearing_accounting_document string,
        clearing_doc_fiscal_year string""",
    ),
    "outbound_delivery_headers": _table(
        "One row per delivery",
        """delivery_document string, actual_goods_movement_date date, creation_date date,
        overall_goods_movement_status string, overall_picking_status string,
        shipping_point string, delivery_block_reason string,
        actual_goods_movement_time string, actual_goods_movement_time_json string,
        creation_time string, creation_time_json string,
        hdr_general_incompletion_status string, header_billing_block_reason string,
        last_change_date date, overall_proof_of_delivery_status string""",
    ),
    "outbound_delivery_items": _table(
        "Delivery lines, each naming the order line it serves",
        """delivery_document string, delivery_document_item string,
        reference_sd_document string, reference_sd_document_item string,
        actual_delivery_quantity string, batch string, delivery_quantity_unit string,
        item_billing_block_reason string, last_change_date date, plant string,
        storage_location string""",
    ),
    "payments_accounts_receivable": _table(
        "Receivable postings and how they were cleared",
        """accounting_document string, accounting_document_item string, customer string,
        clearing_date date, clearing_accounting_document string, posting_date date,
        amount_in_transaction_currency money, transaction_currency string,
        invoice_reference string, sales_document string, gl_account string,
        company_code string, fiscal_year string, clearing_doc_fiscal_year string,
        amount_in_company_code_currency money, company_code_currency string,
        invoice_reference_fiscal_year string, sales_document_item string,
        document_date date, assignment_reference string, financial_account_type string,
        profit_center string, cost_center string""",
    ),
    "plants": _table(
        "Plants",
        """plant string, plant_name string, valuation_area string, plant_customer string,
        plant_supplier string, factory_calendar string,
        default_purchasing_organization string, sales_organization string,
        address_id string, plant_category string, distribution_channel string,
        division string, language string, is_marked_for_archiving boolean""",
    ),
    "product_descriptions": _table(
        "Product names by language",
        """product string, language string, product_description string""",
    ),
    "product_plants": _table(
        "Products by plant",
        """product string, plant string, country_of_origin string, region_of_origin string,
        production_invtry_managed_loc string, availability_check_type string,
        fiscal_year_variant string, profit_center string, mrp_type string""",
    ),
    "product_storage_locations": _table(
        "Products by storage location",
        """product string, plant string, storage_location string,
        physical_inventory_block_ind string, date_of_last_posted_cnt_unrstrcd_stk string,
        date_of_last_posted_cnt_un_rstrcd_stk string""",
    ),
    "products": _table(
        "Product master",
        """product string, product_type string, product_old_id string,
        is_marked_for_deletion boolean, cross_plant_status string,
        cross_plant_status_validity_date date, creation_date date, created_by_user string,
        last_change_date date, last_change_date_time string, gross_weight string,
        weight_unit string, net_weight string, product_group string, base_unit string,
        division string, industry_sector string""",
    ),
    "sales_order_headers": _table(
        "One row per sales order",
        """sales_order string, sales_order_type string, sales_organization string,
        sold_to_party string, creation_date date, requested_delivery_date date,
        total_net_amount money, transaction_currency string,
        overall_delivery_status string, distribution_channel string,
        organization_division string, sales_group string, sales_office string,
        created_by_user string, last_change_date_time string,
        overall_ord_reltd_billg_status string, overall_sd_doc_reference_status string,
        pricing_date date, header_billing_block_reason string,
        delivery_block_reason string, incoterms_classification string,
        incoterms_location1 string, customer_payment_terms string,
        total_credit_check_status string""",
    ),
    "sales_order_items": _table(
        "One row per order line",
        """sales_order string, sales_order_item string, sales_order_item_category string,
        material string, requested_quantity money, requested_quantity_unit string,
        net_amount net, production_plant string, transaction_currency string,
        material_group string, storage_location string, sales_document_rjcn_reason string,
        item_billing_block_reason string""",
    ),
    "sales_order_schedule_lines": _table(
        "Confirmed quantities and days of order lines",
        """sales_order string, sales_order_item string, schedule_line string,
        confirmed_delivery_date date, order_quantity_unit string,
        confd_order_qty_by_matl_avail_check string""",
    ),
}

STAR: dict[str, T.StructType] = {n: _schema(f"star.{n}", c) for n, (_, c) in _STAR.items()}
SAP: dict[str, T.StructType] = {n: _schema(f"sap.{n}", c) for n, (_, c) in _SAP.items()}
DESCRIPTIONS: dict[str, str] = {
    **{f"star.{name}": text for name, (text, _) in _STAR.items()},
    **{f"sap.{name}": text for name, (text, _) in _SAP.items()},
}

# Every table of the document model.
SAP_TABLES = (
    "billing_document_cancellations",
    "billing_document_headers",
    "billing_document_items",
    "business_partner_addresses",
    "business_partners",
    "customer_company_assignments",
    "customer_sales_area_assignments",
    "journal_entry_items_accounts_receivable",
    "outbound_delivery_headers",
    "outbound_delivery_items",
    "payments_accounts_receivable",
    "plants",
    "product_descriptions",
    "product_plants",
    "product_storage_locations",
    "products",
    "sales_order_headers",
    "sales_order_items",
    "sales_order_schedule_lines",
)

# The key of each star table that has one.
KEYS = {
    "customers": "customer_id",
    "orders": "order_id",
    "deliveries": "delivery_id",
    "invoices": "invoice_id",
    "payments": "payment_id",
    "products": "product_id",
}


class Relationship(NamedTuple):
    child: str
    child_key: str
    parent: str
    parent_key: str


# Which column of which table points at which key.
STAR_RELATIONSHIPS = (
    Relationship("orders", "customer_id", "customers", "customer_id"),
    Relationship("deliveries", "order_id", "orders", "order_id"),
    Relationship("invoices", "order_id", "orders", "order_id"),
    Relationship("payments", "customer_id", "customers", "customer_id"),
    Relationship("order_items", "order_id", "orders", "order_id"),
    Relationship("order_items", "product_id", "products", "product_id"),
)
SAP_RELATIONSHIPS = (
    Relationship("sales_order_headers", "sold_to_party", "business_partners", "customer"),
    Relationship("sales_order_items", "sales_order", "sales_order_headers", "sales_order"),
    Relationship(
        "billing_document_items", "billing_document", "billing_document_headers", "billing_document"
    ),
    Relationship(
        "billing_document_headers", "accounting_document",
        "payments_accounts_receivable", "invoice_reference",
    ),
    Relationship(
        "outbound_delivery_items", "reference_sd_document", "sales_order_headers", "sales_order"
    ),
    Relationship("product_descriptions", "product", "products", "product"),
)


def catalog(tables: Tables | Mapping[str, T.StructType]) -> dict[str, list[str]]:
    """Table name -> column names, read from DataFrames or schemas."""
    return {
        name: list(t.columns if isinstance(t, DataFrame) else t.names)
        for name, t in tables.items()
    }
